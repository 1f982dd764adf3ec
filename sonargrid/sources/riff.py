"""RIFF/WAVE on bytes: chunks, samples, metadata and markers, read and written."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np

# Tags of LIST-INFO chunks and the keys they stand for; of keys with several tags the first is written.
INFO_TAGS = {
    "AGES": "Rated", "ICMT": "Comment", "CMNT": "Comment", "IENC": "EncodedBy", "CODE": "EncodedBy", "COMM": "Comments", "DIRC": "Directory",
    "DISP": "SoundSchemeTitle", "IDIT": "DateTimeOriginal", "DTIM": "DateTimeOriginal", "IGNR": "Genre", "GENR": "Genre", "IARL": "ArchivalLocation",
    "IART": "Artist", "IAS1": "FirstLanguage", "IAS2": "SecondLanguage", "IAS3": "ThirdLanguage", "IAS4": "FourthLanguage", "IAS5": "FifthLanguage",
    "IAS6": "SixthLanguage", "IAS7": "SeventhLanguage", "IAS8": "EighthLanguage", "IAS9": "NinthLanguage", "IBSU": "BaseURL", "ICAS": "DefaultAudioStream",
    "ICDS": "ConstumeDesigner", "ICMS": "Commissioned", "ICNM": "Cinematographer", "ICNT": "Country", "ICOP": "Copyright", "ICRD": "DateCreated",
    "ICRP": "Cropped", "IDIM": "Dimensions", "IDPI": "DotsPerInch", "IDST": "DistributedBy", "IEDT": "EditedBy", "IENG": "Engineer", "IKEY": "Keywords",
    "ILGT": "Lightness", "ILGU": "LogoURL", "ILIU": "LogoIconURL", "ILNG": "Language", "LANG": "Language", "IMBI": "MoreInfoBannerImage",
    "IMBU": "MoreInfoBannerURL", "IMED": "Medium", "IMIT": "MoreInfoText", "IMIU": "MoreInfoURL", "IMUS": "MusicBy", "INAM": "Title", "TITL": "Title",
    "IPDS": "ProductionDesigner", "IPLT": "NumColors", "IPRD": "Product", "IPRO": "ProducedBy", "IRIP": "RippedBy", "IRTD": "Rating", "ISBJ": "Subject",
    "ISFT": "Software", "ISGN": "SecondaryGenre", "ISHP": "Sharpness", "ISMP": "TimeCode", "ISRC": "Source", "ISRF": "SourceFrom", "ISTD": "ProductionStudio",
    "ISTR": "Starring", "ITCH": "Technician", "ITRK": "TrackNumber", "TRCK": "TrackNumber", "IWMU": "WatermarkURL", "IWRI": "WrittenBy", "LOCA": "Location",
    "PRT1": "Part", "PRT2": "NumberOfParts", "RATE": "Rate", "STAT": "Statistics", "TAPE": "TapeName", "TCDO": "EndTimecode", "TCOD": "StartTimecode",
    "TLEN": "Length", "TORG": "Organization", "TURL": "URL", "TVER": "Version", "VMAJ": "VegasVersionMajor", "VMIN": "VegasVersionMinor", "YEAR": "Year",
    "BITS": "Bits", "PINS": "Pins", "AVRG": "Averaging", "CNVS": "ConversionSpeed", "SMPS": "SamplingSpeed", "VREF": "ReferenceVoltage", "GAIN": "Gain",
    "UWRP": "UnwrapThreshold", "UWPC": "UnwrapClippedAmplitude", "IBRD": "uCBoard", "IMAC": "MACAdress", "CPUF": "CPU frequency",
}
# Text fields of the BEXT chunk with their widths, and its numbers with their formats, in order.
BEXT = [("Description", "256s"), ("Originator", "32s"), ("OriginatorReference", "32s"), ("OriginationDate", "10s"), ("OriginationTime", "8s"), ("TimeReference", "Q"), ("Version", "H"),
        ("UMID", "64s"), ("LoudnessValue", "h"), ("LoudnessRange", "h"), ("MaxTruePeakLevel", "h"), ("MaxMomentaryLoudness", "h"), ("MaxShortTermLoudness", "h"), ("Reserved", "180s")]
_BEXT = struct.Struct("<" + "".join(f for _, f in BEXT))
#: {encoding: (WAVE format tag, bits)}
ENCODINGS = {"PCM_U8": (1, 8), "PCM_16": (1, 16), "PCM_24": (1, 24), "PCM_32": (1, 32), "PCM_64": (1, 64), "FLOAT": (3, 32), "DOUBLE": (3, 64)}
_ROOT = "BWFXML"


@dataclass
class Riff:
    """What a file holds. ``metadata`` is nested; ``markers`` are (pos, span, label, text) in order of pos."""

    channels: int = 0
    rate: float = 0.0
    encoding: str = ""
    frames: int = 0
    data_pos: int = 0
    chunks: list[tuple[str, int, int]] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    markers: list[tuple[int, int, str | None, str | None]] = field(default_factory=list)


class FileBytes:
    """Slices of an open file as bytes, read when they are asked for; what ``parse`` doesn't look at, such as samples, is never read."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        self.file.seek(start)
        return self.file.read(max(0, stop - start))


def chunk_table(raw: bytes | FileBytes) -> list[tuple[str, int, int]]:
    """(tag, payload position, payload size rounded up to even) in order; LIST chunks carry their type. ValueError if it is no RIFF file."""
    if len(raw) < 12 or raw[:4] != b"RIFF":
        raise ValueError("not a RIFF file")
    found, at = [], 12
    while at + 8 <= len(raw):
        head = raw[at : at + 12]
        tag, size = head[:4].decode("latin-1").upper(), struct.unpack_from("<I", head, 4)[0]
        size += size % 2
        if tag == "LIST":
            tag = f"LIST-{head[8:12].decode('latin-1').upper()}"
        found.append((tag, at + 8, size))
        at += 8 + size
    return found


def _text(b: bytes) -> str:
    codec = "cp1252" if any(0x80 <= c <= 0x9F for c in b) else "latin-1"
    return b.decode(codec, "replace").rstrip(" \x00\x02")


def _encoded(text: str) -> bytes | None:
    """A text in Latin-1 or else Windows-1252, so that ``_text`` reads it; None if neither has its characters."""
    for codec in ("latin-1", "cp1252"):
        try:
            b = text.encode(codec)
        except UnicodeEncodeError:
            continue
        if _text(b) == text.rstrip(" \x00\x02"):
            return b
    return None


def _label_text(b: bytes) -> str:
    """Text of a label: UTF-8 where the bytes are, else as other texts."""
    try:
        return b.decode("utf-8").rstrip(" \x00\x02")
    except UnicodeDecodeError:
        return _text(b)


def _label_bytes(text: str) -> bytes:
    """A label in Latin-1 or Windows-1252 if it can be told from UTF-8, else in UTF-8: ``_label_text`` reads what was written."""
    b = _encoded(text)
    return b if b is not None and _label_text(b) == text.rstrip(" \x00\x02") else text.encode("utf-8", "surrogatepass")


def _info(b: bytes, keep_empty: bool) -> dict:
    out, at = {}, 4
    while at + 8 <= len(b):
        tag, size = b[at : at + 4].decode("latin-1").rstrip().upper(), struct.unpack_from("<I", b, at + 4)[0]
        value = _text(b[at + 8 : at + 8 + size])
        if value or keep_empty:
            out[INFO_TAGS.get(tag, tag)] = value
        at += 8 + size + size % 2
    return out


def _bext(b: bytes, keep_empty: bool) -> dict:
    out: dict = {}
    values = _BEXT.unpack(b[: _BEXT.size].ljust(_BEXT.size, b"\0"))
    for (name, _), v in zip(BEXT, values):
        v = v.decode("latin-1").strip(" \x00") if isinstance(v, bytes) else v
        if keep_empty or (v if isinstance(v, str) else v > 0):
            out[name] = v
    rest = b[_BEXT.size :].decode("latin-1").strip(" \x00\r\n")
    if rest or keep_empty:
        out["CodingHistory"] = rest
    return out


def _xml(node: ET.Element, keep_empty: bool) -> dict | str:
    text = (node.text or "").strip()
    if len(node) and not text:
        return {c.tag: v for c in node if (v := _xml(c, keep_empty)) or keep_empty}
    return text


def _ixml(b: bytes, keep_empty: bool) -> dict:
    got = _xml(ET.fromstring(b.rstrip(b" \x00\x02").decode("utf-8", "replace")), keep_empty)
    return got if isinstance(got, dict) else {}


def _guano(b: bytes) -> dict:
    out: dict = {}
    for line in b.decode("utf-8", "replace").rstrip("\x00 \r\n").splitlines():
        key, colon, value = line.partition(":")
        if not colon:
            continue
        *path, name = key.split("|")
        at = out
        for p in path:
            at = at.setdefault(p.strip(), {})
        at[name.strip()] = value.strip().replace("\\n", "\n")
    return out


def _markers(raw: bytes | FileBytes, chunks: list[tuple[str, int, int]], rate: float) -> list[tuple[int, int, str | None, str | None]]:
    points: dict[int, list] = {}
    for tag, pos, size in chunks:
        if tag == "CUE " and size >= 4:
            body = raw[pos : pos + size]
            for i in range(min(struct.unpack_from("<I", body)[0], (len(body) - 4) // 24)):
                ident, at, kind = struct.unpack_from("<II4s", body, 4 + 24 * i)
                if kind.upper() == b"DATA":
                    points.setdefault(ident, [at, 0, None, None])
    for tag, pos, size in chunks:
        if tag == "PLST" and size >= 4:
            body = raw[pos : pos + size]
            for i in range(min(struct.unpack_from("<I", body)[0], (len(body) - 4) // 12)):
                ident, length, _ = struct.unpack_from("<III", body, 4 + 12 * i)
                if ident in points:
                    points[ident][1] = length
        if tag == "LIST-ADTL":
            part, at = raw[pos : pos + size], 4
            while at + 12 <= len(part):
                key, n, ident = struct.unpack_from("<4sII", part, at)
                body = part[at + 12 : at + 8 + n]
                m = points.get(ident)
                if m and key.upper() in (b"LABL", b"NOTE"):
                    m[2] = "|".join(filter(None, (m[2], _label_text(body)))) or None
                elif m and key.upper() == b"LTXT" and len(body) >= 4:
                    m[1] = struct.unpack_from("<I", body)[0]
                    m[3] = "|".join(filter(None, (m[3], _label_text(body[16:])))) or None
                at += 8 + n + n % 2
    out = [tuple(m) for m in points.values()]
    for tag, pos, size in chunks:
        if tag == "LBL ":
            body = raw[pos : pos + size]
            for i in range(size // 65):
                fields = _label_text(body[65 * i : 65 * (i + 1)]).split("\t")
                if len(fields) >= 4:
                    start, stop = (int(np.rint(float(f.strip("\x00")) * rate)) for f in fields[:2])
                    label = fields[3].strip(" \r\n\x00")
                    out.append((start, stop - start if label in ("M", "N", "O", "P") else 0, label or None, fields[2].strip() or None))
    return sorted(out, key=lambda m: (m[0], m[1]))


def layout(raw: bytes | FileBytes) -> Riff:
    """Chunks, format and place of the samples; ValueError if it is no RIFF file."""
    r = Riff(chunks=chunk_table(raw))
    last = {tag: (pos, size) for tag, pos, size in r.chunks}
    if "FMT " in last:
        pos, size = last["FMT "]
        body = raw[pos : pos + size]
        kind, r.channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
        if kind == 0xFFFE and size >= 26:
            kind = struct.unpack_from("<H", body, 24)[0]
        r.rate = float(rate)
        r.encoding = next((e for e, v in ENCODINGS.items() if v == (kind, bits)), "")
        if "DATA" in last:
            r.data_pos = last["DATA"][0]
            size = min(struct.unpack_from("<I", raw[r.data_pos - 4 : r.data_pos])[0], len(raw) - r.data_pos)
            r.frames = size // max(1, r.channels * (bits // 8))
    return r


def parse(raw: bytes | FileBytes, keep_empty: bool = False) -> Riff:
    """Everything but the samples; ValueError if it is no RIFF file. Of a tag that comes twice the last chunk counts."""
    r = layout(raw)
    last = {tag: (pos, size) for tag, pos, size in r.chunks}
    for tag, (pos, size) in last.items():
        if tag not in ("LIST-INFO", "BEXT", "IXML", "GUAN"):
            continue
        body = raw[pos : pos + size]
        if tag == "LIST-INFO":
            part: dict = {"INFO": _info(body, keep_empty)}
        elif tag == "BEXT":
            part = {"BEXT": _bext(body, keep_empty)}
        elif tag == "IXML":
            part = {"IXML": _ixml(body, keep_empty)}
        else:
            part = _guano(body)
        r.metadata |= {k: v for k, v in part.items() if v or keep_empty}
    r.markers = _markers(raw, r.chunks, r.rate)
    return r


def samples(raw: bytes, r: Riff, start: int = 0, stop: int | None = None) -> np.ndarray:
    """(frames, channels) doubles in [-1, 1] of the frames from start to stop."""
    return decode(raw[r.data_pos + start * frame_bytes(r) : r.data_pos + (r.frames if stop is None else min(stop, r.frames)) * frame_bytes(r)], r.encoding, r.channels)


def frame_bytes(r: Riff) -> int:
    return r.channels * ENCODINGS[r.encoding][1] // 8


def decode(b: bytes, encoding: str, channels: int) -> np.ndarray:
    """Bytes of whole frames as doubles. ValueError for an unknown encoding."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    kind, bits = ENCODINGS[encoding]
    if encoding == "PCM_24":
        t = np.frombuffer(b, np.uint8).reshape(-1, 3).astype(np.int32)
        v = ((t[:, 0] << 8 | t[:, 1] << 16 | t[:, 2] << 24) >> 8) / 2.0**23
    elif kind == 3:
        v = np.frombuffer(b, f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        v = np.frombuffer(b, np.uint8) / 128.0 - 1.0
    else:
        v = np.frombuffer(b, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return v.reshape(-1, channels)


def encode(x: np.ndarray, encoding: str, rounding: str = "floor") -> bytes:
    """Doubles as bytes; whole numbers saturate at both ends."""
    kind, bits = ENCODINGS[encoding]
    if kind == 3:
        return x.astype(f"<f{bits // 8}").tobytes()
    top = 2.0 ** (bits - 1)
    v = (np.floor if rounding == "floor" else np.trunc)(x * top)
    most = np.nextafter(top, 0) if bits == 64 else top - 1
    v = np.clip(np.nan_to_num(v), -top, most)
    if bits == 8:
        return (v + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return np.ascontiguousarray(v.astype("<i4").reshape(-1).view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return v.astype(f"<i{bits // 8}").tobytes()


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _info_chunk(md: dict) -> bytes | None:
    tags = {name: tag for tag, name in reversed(INFO_TAGS.items())}
    if any(isinstance(v, dict) or (k not in tags and len(k) > 4) for k, v in md.items()):
        return None
    texts = [_encoded(str(v)) for v in md.values()]
    keys = [_encoded(tags.get(k, k).ljust(4)) for k in md]
    if None in texts or None in keys:
        return None  # the GUANO chunk can hold any character
    return _chunk(b"LIST", b"INFO" + b"".join(_chunk(k, t + b"\0") for k, t in zip(keys, texts))) if md else b""


def _bext_chunk(md: dict) -> bytes | None:
    if not set(md) <= {n for n, _ in BEXT} | {"CodingHistory"}:
        return None
    try:
        values = [str(md.get(n, "")).encode("latin-1")[: int(f[:-1])] if f.endswith("s") else int(md.get(n) or 0) for n, f in BEXT]
        return _chunk(b"BEXT", _BEXT.pack(*values) + str(md.get("CodingHistory", "")).encode("latin-1"))
    except UnicodeEncodeError:
        return None


def _ixml_chunk(md: dict) -> bytes | None:
    def fits(d: dict) -> bool:
        return all(k.replace("_", "").isalnum() and k[:1].isalpha() and (not isinstance(v, dict) or fits(v)) for k, v in d.items())

    def build(node: ET.Element, d: dict) -> None:
        for k, v in d.items():
            child = ET.SubElement(node, k)
            if isinstance(v, dict):
                build(child, v)
            else:
                child.text = str(v)

    if not fits(md):
        return None
    root = ET.Element(_ROOT)
    build(root, md)
    return _chunk(b"iXML", ET.tostring(root, "utf-8", xml_declaration=True))


def _guano_chunk(md: dict) -> bytes:
    def lines(d: dict, prefix: str):
        for k, v in d.items():
            if isinstance(v, dict):
                yield from lines(v, f"{prefix}{k}|")
            else:
                yield f"{prefix}{k}:{str(v).replace(chr(10), chr(92) + 'n')}"

    return _chunk(b"guan", "\n".join((["GUANO|Version:1.0"] if "GUANO" not in md else []) + list(lines(md, ""))).encode("utf-8")) if md else b""


def metadata_chunks(md: dict) -> bytes:
    """INFO, BEXT and IXML sections in chunks of their own where these can hold them, everything else in a GUANO chunk."""
    out, rest = b"", {}
    for key, v in md.items():
        make = {"INFO": _info_chunk, "BEXT": _bext_chunk, "IXML": _ixml_chunk}.get(key.upper())
        chunk = make(v) if make and isinstance(v, dict) else None
        if chunk is None:
            rest[key] = v
        else:
            out += chunk
    return out + _guano_chunk(rest)


def marker_chunks(markers: list[tuple], rate: float, hint: str = "cue") -> bytes:
    """Markers (pos, span, label, text) in order of pos, as cue points with lists of spans and labels, or as 65-byte lines with hint "lbl"."""
    if hint not in ("cue", "lbl"):
        raise ValueError("the marker hint must be cue or lbl")
    markers = sorted(markers, key=lambda m: (m[0], m[1] or 0))
    if not markers:
        return b""
    if hint == "lbl":

        def line(m: tuple) -> bytes:
            text, label = m[3] or "", m[2] or ""
            while True:
                b = _label_bytes(f"{m[0] / rate:.7g}\t{(m[0] + (m[1] or 0)) / rate:.7g}\t{text}\t{label}")
                if len(b) <= 63:
                    return b.ljust(63) + b"\r\n"
                text, label = (text[:-1], label) if text else ("", label[:-1])  # whole characters, of the label last

        return _chunk(b"LBL ", b" " * 63 + b"\r\n" + b"".join(map(line, markers)))
    out = _chunk(b"CUE ", struct.pack("<I", len(markers)) + b"".join(struct.pack("<II4sIII", i, m[0], b"data", 0, 0, 0) for i, m in enumerate(markers)))
    spans = [(i, m[1]) for i, m in enumerate(markers) if (m[1] or 0) > 0]
    if spans:
        out += _chunk(b"PLST", struct.pack("<I", len(spans)) + b"".join(struct.pack("<III", i, s, 1) for i, s in spans))
    body = b""
    for i, (_, span, label, text) in enumerate(markers):
        if label:
            body += _chunk(b"labl", struct.pack("<I", i) + _label_bytes(label) + b"\0")
        if text:
            body += _chunk(b"ltxt", struct.pack("<IIIHHHH", i, span or 0, 0, 0, 0, 0, 0) + _label_bytes(text) + b"\0")
    return out + (_chunk(b"LIST", b"adtl" + body) if body else b"")


def frame_of(frames: int, channels: int, rate: float, encoding: str, md: dict | None = None, markers: list[tuple] = (), hint: str = "cue") -> tuple[bytes, bytes]:
    """(what comes before, what comes after) the samples in a file. ValueError for an encoding that WAVE doesn't have, and for more than its 4 GB."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    kind, bits = ENCODINGS[encoding]
    width = channels * bits // 8
    fmt = _chunk(b"fmt ", struct.pack("<HHIIHH", kind, channels, int(rate), int(rate) * width, width, bits))
    head, tail = b"WAVE" + fmt + metadata_chunks(md or {}), marker_chunks(list(markers), rate, hint)
    size = frames * width
    total = len(head) + 8 + size + size % 2 + len(tail)
    if total >= 1 << 32:
        raise ValueError(f"{frames} frames of {channels} channels exceed the 4 GB of a RIFF file; write several")
    return b"RIFF" + struct.pack("<I", total) + head + b"data" + struct.pack("<I", size), b"\0" * (size % 2) + tail


def build(x: np.ndarray, rate: float, encoding: str = "PCM_16", md: dict | None = None, markers: list[tuple] = (), hint: str = "cue", rounding: str = "floor") -> bytes:
    """A whole RIFF/WAVE file of (frames, channels) doubles."""
    head, tail = frame_of(*x.shape, rate, encoding, md, markers, hint)
    return head + encode(x, encoding, rounding) + tail


def opened(file, size: int, path: str):
    """(layout, read(start, stop)) of an open file; ValueError if it is none that can be read."""
    r = layout(FileBytes(file, size))
    if not r.encoding:
        raise ValueError("no known encoding")
    width = frame_bytes(r)

    def read(start: int, stop: int) -> np.ndarray:
        file.seek(r.data_pos + start * width)
        return decode(file.read((min(stop, r.frames) - start) * width), r.encoding, r.channels)

    return r, read


def rebuild(raw: bytes, md: dict | None = None, markers: list[tuple] | None = None, hint: str = "cue") -> bytes:
    """The file with other metadata, other markers, or both; its samples stay as they are."""
    r = parse(raw)
    drop = {"LIST-INFO", "BEXT", "IXML", "GUAN"} if md is not None else set()
    drop |= {"CUE ", "PLST", "LIST-ADTL", "LBL "} if markers is not None else set()
    kept = b"".join(raw[pos - 8 : pos + size] for tag, pos, size in r.chunks if tag not in drop)
    body = b"WAVE" + kept + (metadata_chunks(md) if md is not None else b"") + (marker_chunks(markers, r.rate, hint) if markers is not None else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def metadata_rows(md: dict) -> list[tuple[int, int, list[str], str, str | None, str, bool]]:
    """(ord, dict_ord, path, key, value, vtype, is_section) in pre-order."""
    rows: list[tuple] = []
    dicts = [0]

    def walk(d: dict, path: list[str], number: int) -> None:
        for k, v in d.items():
            if isinstance(v, dict):
                rows.append((len(rows), number, path, k, None, "dict", True))
                dicts[0] += 1
                walk(v, [*path, k], dicts[0])
            else:
                rows.append((len(rows), number, path, k, str(v), type(v).__name__, False))

    walk(md, [], 0)
    return rows


def metadata_dict(rows: list[tuple[int, list[str], str, str | None, bool]]) -> dict:
    """Nested metadata of rows (ord, path, key, value, is_section), the reverse of ``metadata_rows`` but for types."""
    out: dict = {}
    for _, path, key, value, section in sorted(rows, key=lambda r: r[0]):
        at = out
        for p in path:
            at = at.setdefault(p, {})
        if section:
            at.setdefault(key, {})
        else:
            at[key] = "" if value is None else value
    return out
