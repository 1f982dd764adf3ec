"""Codecs by name: what they are called, what they read and write, and in which order they are tried.

A decoder is a function ``(file, size, path) -> (layout, read)``: ``layout`` has channels, rate, encoding and frames as ``riff.Riff`` has, ``read(start, stop)``
gives (frames, channels) doubles. An encoder is a function ``(x, rate, encoding, metadata, markers) -> bytes``. Codecs for packages that may be
missing are there if the package can be imported.
"""

from __future__ import annotations

import wave
from collections.abc import Callable
from dataclasses import dataclass
from importlib.util import find_spec

import numpy as np

from sonargrid.sources import riff


@dataclass
class Codec:
    name: str
    formats: list[str]
    encodings: list[str]
    suffixes: tuple[str, ...] = ()
    decoder: Callable | None = None
    encoder: Callable | None = None
    available: Callable[[], bool] = lambda: True
    #: Whether any range of frames can be read without what is before it.
    splits: bool = False


def _wave(file, size: int, path: str):
    """PCM by the standard library."""
    w = wave.open(file)
    width, channels = w.getsampwidth(), w.getnchannels()
    encoding = "PCM_U8" if width == 1 else f"PCM_{8 * width}"

    def read(start: int, stop: int) -> np.ndarray:
        w.setpos(start)
        return riff.decode(w.readframes(stop - start), encoding, channels)

    return riff.Riff(channels=channels, rate=float(w.getframerate()), encoding=encoding, frames=w.getnframes()), read


def _soundfile(file, size: int, path: str):
    import soundfile

    f = soundfile.SoundFile(file)

    def read(start: int, stop: int) -> np.ndarray:
        f.seek(start)
        return f.read(stop - start, dtype="float64", always_2d=True)

    return riff.Riff(channels=f.channels, rate=float(f.samplerate), encoding=f.subtype, frames=f.frames), read


def _soundfile_encoder(x: np.ndarray, rate: float, encoding: str, metadata: dict, markers: list, format: str = "FLAC") -> bytes:
    import io

    import soundfile

    out = io.BytesIO()
    soundfile.write(out, x, int(rate), subtype=encoding, format=format)
    return out.getvalue()


def _wavefile(file, size: int, path: str):
    import wavefile

    f = wavefile.WaveReader(path)

    def read(start: int, stop: int) -> np.ndarray:
        f.seek(start)
        buffer = np.zeros((f.channels, stop - start), np.float64, order="F")
        return buffer[:, : f.read(buffer)].T

    return riff.Riff(channels=f.channels, rate=float(f.samplerate), encoding="", frames=f.frames), read


def _audioread(file, size: int, path: str):
    import audioread

    with audioread.audio_open(path) as f:
        channels, rate = f.channels, float(f.samplerate)
        x = riff.decode(b"".join(f), "PCM_16", channels)  # can only be read from the start
    return riff.Riff(channels=channels, rate=rate, encoding="PCM_16", frames=len(x)), lambda start, stop: x[start:stop]


def _there(package: str) -> Callable[[], bool]:
    return lambda: find_spec(package) is not None


#: In order of preference.
CODECS: dict[str, Codec] = {
    c.name: c
    for c in (
        Codec("riff", ["WAV", "WAVEX"], list(riff.ENCODINGS), (".wav", ".wave"), riff.opened, None, splits=True),
        Codec("wave", ["WAV"], ["PCM_U8", "PCM_16", "PCM_24", "PCM_32"], (".wav", ".wave"), _wave, splits=True),
        Codec("soundfile", ["WAV", "FLAC", "OGG"], ["PCM_16", "PCM_24", "VORBIS"], (".wav", ".flac", ".ogg", ".aiff", ".aif"), _soundfile, _soundfile_encoder, _there("soundfile")),
        Codec("wavefile", ["WAV", "FLAC", "OGG"], ["PCM_16"], (".wav", ".flac", ".ogg"), _wavefile, None, _there("wavefile")),
        Codec("audioread", ["MP3", "M4A"], ["PCM_16"], (".mp3", ".m4a", ".ogg", ".wma"), _audioread, None, _there("audioread")),
    )
}
_OFF: set[str] = set()


def register(name: str, formats: list[str], encodings: list[str], available: Callable[[], bool] = lambda: True, suffixes: tuple[str, ...] = (), decoder: Callable | None = None, encoder: Callable | None = None, splits: bool = False, first: bool = False) -> None:
    """Add a codec behind those that are there, or before them. The source takes the codecs as they are when it is registered with a session."""
    codec = Codec(name, formats, encodings, tuple(s.lower() for s in suffixes), decoder, encoder, available, splits)
    rest = {n: c for n, c in CODECS.items() if n != name}
    CODECS.clear()
    CODECS.update({name: codec} | rest if first else rest | {name: codec})


def remove(name: str) -> None:
    CODECS.pop(name, None)


def installed() -> list[str]:
    return [n for n, c in CODECS.items() if c.available()]


def available() -> list[str]:
    return [n for n in installed() if n not in _OFF]


def unavailable() -> list[str]:
    return [n for n in CODECS if n not in available()]


def disable(name: str | None = None) -> None:
    """Switch a codec off, or all of them."""
    _OFF.update([name] if name else CODECS)


def enable(name: str | None = None) -> None:
    _OFF.difference_update([name] if name else list(CODECS))


def select(name: str) -> bool:
    """Switch all codecs but one off; False and no change if it is unknown."""
    if name not in installed():
        return False
    disable()
    enable(name)
    return True


def decoders() -> list[Codec]:
    """Available codecs that read, in order of preference."""
    return [CODECS[n] for n in available() if CODECS[n].decoder]


def formats() -> list[str]:
    return sorted({f for n in available() for f in CODECS[n].formats})


def encodings(format: str) -> list[str]:
    """Encodings of a format by the first codec that has it."""
    return next((list(CODECS[n].encodings) for n in available() if format.upper() in CODECS[n].formats), [])


def opened(codecs: list[Codec], file, size: int, path: str):
    """(codec, layout, read) by the first codec for the path's suffix that can read the file. ValueError with what all of them said if none can."""
    if size == 0:
        raise ValueError(f"{path} is empty")
    said = []
    for c in codecs:
        if c.suffixes and not path.lower().endswith(c.suffixes):
            continue
        try:
            file.seek(0)
            return (c, *c.decoder(file, size, path))
        except Exception as e:  # noqa: BLE001 - the next one may read it
            said.append(f"{c.name}: {e}")
    raise ValueError(f"{path} can't be read ({'; '.join(said) or 'no codec for its suffix'})")
