"""Algebra on nested metadata as rows (rec_id, ord, dict_ord, path, key, value, vtype, is_section).

``path`` lists the enclosing sections, ``ord`` is the place in pre-order and ``dict_ord`` that of the row's dict. Keys and sections
are found in any case. A recording's metadata is small, so the row is the unit; nothing is collected beyond one recording's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonargrid.functions import quantities, texts
from sonargrid.sources import riff

START_KEYS = [["DateTimeOriginal"], ["OriginationDate", "OriginationTime"], ["Location_Time"], ["Timestamp"]]
REFERENCE_KEYS, GAIN_KEYS, HISTORY_KEYS = ["TimeReference"], ["gain"], ["History", "CodingHistory", "BWF_CODING_HISTORY"]
_SEP = "\u0001"
_ISO = r"^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?\s*$"


def distinct_rows(m: DataFrame) -> DataFrame:
    """One row per (rec_id, ord), null keys left out."""
    rest = [c for c in m.columns if c not in ("rec_id", "ord")]
    return m.where("key IS NOT NULL AND ord IS NOT NULL").groupBy("rec_id", "ord").agg(F.min(F.struct(*rest)).alias("m")).select("rec_id", "ord", "m.*")


def _leaves(m: DataFrame) -> DataFrame:
    return m.where("coalesce(is_section, false) = false")


def flatten(m: DataFrame, keep_sections: bool = False, sep: str = ".") -> DataFrame:
    """(rec_id, key, value): flat metadata; keys with their sections before them, or bare, of which the last by ord counts."""
    key = F.concat_ws(sep, "path", F.col("key")) if keep_sections else F.col("key")
    return _leaves(m).groupBy("rec_id", key.alias("key")).agg(F.max_by("value", "ord").alias("value"))


def unflatten(flat: DataFrame, sep: str = ".") -> DataFrame:
    """(rec_id, path, key, value) of flat rows (rec_id, key, value); sections met again are the same section."""
    parts = F.split("key", f"\\Q{sep}\\E")
    return flat.select("rec_id", F.slice(parts, 1, F.size(parts) - 1).alias("path"), F.element_at(parts, -1).alias("key"), "value")


def find(m: DataFrame, key: str, sep: str = ".") -> DataFrame:
    """(rec_id, ord, path, key, value): the first match per recording.

    A key of one part is looked for in each dict before its sections, in pre-order of the dicts. In one of several parts the
    first part that names a section leads into it for good; the search there goes on with the rest.
    """
    parts = [p.lower() for p in key.split(sep)]
    rows = m.withColumn("p", F.transform("path", lambda x: F.lower(x)))
    if len(parts) > 1:
        # the first section of each name in turn; what is not below it is out
        for part in parts[:-1]:
            sections = rows.where("coalesce(is_section, false)").where(F.lower("key") == part)
            first = sections.groupBy("rec_id").agg(F.min_by(F.concat_ws(_SEP, "p", F.lower("key")), F.struct("dict_ord", "ord")).alias("under"))
            at = F.concat_ws(_SEP, "p")
            rows = rows.join(first, "rec_id").where((at == F.col("under")) | at.startswith(F.concat(F.col("under"), F.lit(_SEP)))).drop("under")
    found = _leaves(rows).where(F.lower("key") == parts[-1])
    best = found.groupBy("rec_id").agg(F.min_by(F.struct("ord", "path", "key", "value"), F.struct("dict_ord", "ord")).alias("f"))
    return best.select("rec_id", "f.*")


def lookup(m: DataFrame, keys: list[str], good: Column | None = None, sep: str = ".") -> DataFrame:
    """(rec_id, ord, key, value): the match of the first key in the list that has one, and for which ``good`` of its value holds."""
    found = None
    for i, k in enumerate(keys):
        f = find(m, k, sep).withColumn("priority", F.lit(i))
        found = f if found is None else found.unionByName(f)
    found = found.where(good) if good is not None else found
    return found.groupBy("rec_id").agg(F.min_by(F.struct("ord", "key", "value"), "priority").alias("f")).select("rec_id", "f.*")


def get_number_unit(m: DataFrame, keys: list[str]) -> DataFrame:
    """(rec_id, value, unit): number and unit of the first key with a number."""
    q = quantities.parse_number(F.col("value"))
    return lookup(m, keys, q["value"].isNotNull()).select("rec_id", q["value"].alias("value"), q["unit"].alias("unit"))


def get_number(m: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """(rec_id, value): the number converted to ``unit``."""
    return get_number_unit(m, keys).select("rec_id", quantities.change_unit(F.col("value"), F.col("unit"), F.lit(unit)).alias("value"))


def get_int(m: DataFrame, keys: list[str]) -> DataFrame:
    """(rec_id, value): whole number without decimals of the first key with one."""
    q = quantities.parse_number(F.col("value"))
    return lookup(m, keys, q["is_int"]).select("rec_id", q["value"].cast("bigint").alias("value"))


def get_bool(m: DataFrame, keys: list[str]) -> DataFrame:
    """(rec_id, value): text such as "yes" or "false" of the first key with one, else whether the first number is not 0."""
    v = F.lower(F.trim("value"))
    words = F.when(v.isin("true", "yes", "on"), True).when(v.isin("false", "no", "off"), False)
    number = quantities.parse_number(F.col("value"))["value"]
    by_word = lookup(m, keys, words.isNotNull()).select("rec_id", words.alias("w"))
    by_number = lookup(m, keys, number.isNotNull()).select("rec_id", (number != 0).alias("n"))
    return by_word.join(by_number, "rec_id", "full").select("rec_id", F.coalesce("w", "n").alias("value"))


def get_str(m: DataFrame, keys: list[str]) -> DataFrame:
    return lookup(m, keys, F.col("value").isNotNull()).select("rec_id", "value")


def get_datetime(m: DataFrame, keys: list[list[str]] = START_KEYS) -> DataFrame:
    """(rec_id, value TIMESTAMP_NTZ): of the first key, or pair of keys for date and time, that gives a valid one in ISO form."""
    found = None
    for i, k in enumerate(keys):
        f = find(m, k[0]).select("rec_id", F.col("value").alias("said"))
        if len(k) == 2:
            f = f.join(find(m, k[1]).select("rec_id", F.col("value").alias("t")), "rec_id").select("rec_id", F.concat_ws("T", F.trim("said"), F.trim("t")).alias("said"))
        f = f.select("rec_id", F.lit(i).alias("priority"), F.when(F.col("said").rlike(_ISO), F.trim("said")).try_cast("timestamp_ntz").alias("value")).where("value IS NOT NULL")
        found = f if found is None else found.unionByName(f)
    return found.groupBy("rec_id").agg(F.min_by("value", "priority").alias("value"))


def set_values(m: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Metadata with the first match of each key set to a new value; keys without a match change nothing."""
    return _replace(m, [find(m, k).select("rec_id", "ord", F.lit(v).alias("new")) for k, v in changes.items()])


def _replace(m: DataFrame, parts: list[DataFrame]) -> DataFrame:
    new = parts[0].withColumn("turn", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        new = new.unionByName(p.withColumn("turn", F.lit(i)))
    new = new.groupBy("rec_id", "ord").agg(F.max_by("new", "turn").alias("new"))
    return m.join(new, ["rec_id", "ord"], "left").withColumn("value", F.coalesce("new", "value")).select(*m.columns)


def add_values(m: DataFrame, additions: dict[str, str], sep: str = ".") -> DataFrame:
    """Metadata with keys set, or appended after all rows in sections that are made where they are missing."""
    result = set_values(m, additions)
    last = m.groupBy("rec_id").agg(F.max("ord").alias("o"), F.max("dict_ord").alias("d"))
    for i, (key, value) in enumerate(additions.items()):
        missing = last.join(find(m, key, sep).select("rec_id"), "rec_id", "left_anti")
        *path, name = key.split(sep)
        where = F.array(*[F.lit(p) for p in path]).cast("array<string>")
        row = {"path": where, "key": F.lit(name), "value": F.lit(value), "vtype": F.lit("str"), "is_section": F.lit(False), "ord": (F.col("o") + 1 + i).cast("int"), "dict_ord": F.when(F.lit(not path), 0).otherwise(F.col("d") + 1 + i).cast("int")}
        result = result.unionByName(missing.select("rec_id", *[c.alias(k) for k, c in row.items()]).select(*m.columns))
    return result


def add_missing(m: DataFrame, key: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Metadata with a value added at the top level of recordings that have none of ``keys``, by default the key itself."""
    has = F.max((~F.coalesce("is_section", F.lit(False)) & F.lower("key").isin([k.lower() for k in keys or [key]])).cast("int"))
    none = m.groupBy("rec_id").agg(has.alias("has"), (F.max("ord") + 1).cast("int").alias("ord")).where("has = 0")
    row = {"dict_ord": F.lit(0), "path": F.array().cast("array<string>"), "key": F.lit(key), "value": F.lit(value), "vtype": F.lit("str"), "is_section": F.lit(False)}
    return m.unionByName(none.select("rec_id", "ord", *[c.alias(k) for k, c in row.items()]).select(*m.columns))


def add_sections(m: DataFrame, section: str, sep: str = ".") -> DataFrame:
    """Metadata with a section, and those around it, as rows of their own after all others, where they are missing; names match in any case."""
    path = section.split(sep)
    out = m
    for i in range(len(path)):
        at = _SEP.join(p.lower() for p in path[: i + 1])
        there = out.where("coalesce(is_section, false)").where(F.lower(F.concat_ws(_SEP, "path", F.col("key"))) == at).select("rec_id").distinct()
        last = out.groupBy("rec_id").agg((F.max("ord") + 1).cast("int").alias("ord")).join(there, "rec_id", "left_anti")
        row = {"path": F.array(*[F.lit(p) for p in path[:i]]).cast("array<string>"), "key": F.lit(path[i]), "value": F.lit(None).cast("string"), "vtype": F.lit("dict"), "is_section": F.lit(True), "dict_ord": F.lit(0)}
        out = out.unionByName(last.select("rec_id", "ord", *[c.alias(k) for k, c in row.items()]).select(*m.columns))
    return out


def remove(m: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata without the first match of each key; a section goes with all that is in it."""
    gone = None
    for k in keys:
        first = m.where(F.lower("key") == k.lower()).groupBy("rec_id").agg(F.min_by(F.struct("ord", F.concat_ws(_SEP, "path", F.col("key")).alias("at"), F.coalesce("is_section", F.lit(False)).alias("section")), F.struct("dict_ord", "ord")).alias("g"))
        part = m.join(first, "rec_id").where((F.col("ord") == F.col("g.ord")) | (F.col("g.section") & F.concat(F.concat_ws(_SEP, "path"), F.lit(_SEP)).startswith(F.concat(F.col("g.at"), F.lit(_SEP))))).select("rec_id", "ord")
        gone = part if gone is None else gone.unionByName(part)
    return m.join(gone.distinct(), ["rec_id", "ord"], "left_anti")


def move(m: DataFrame, key: str, section: str, new_key: str | None = None) -> DataFrame:
    """Metadata with the first match of a key moved to a section of the top level, under a new name if given."""
    at = find(m, key).select("rec_id", "ord", F.lit(True).alias("moved"))
    moved = m.join(at, ["rec_id", "ord"], "left")
    return moved.withColumns({"path": F.when(F.col("moved"), F.array(F.lit(section))).otherwise(F.col("path")), "key": F.when(F.col("moved"), F.lit(new_key or key)).otherwise(F.col("key"))}).select(*m.columns)


def cleanup(m: DataFrame) -> DataFrame:
    """Metadata without sections that hold nothing; a section that only this empties stays."""
    at = F.concat_ws(_SEP, F.lower(F.concat_ws(_SEP, "path", F.col("key"))))
    full = m.select("rec_id", F.lower(F.concat_ws(_SEP, "path")).alias("at")).distinct().withColumn("full", F.lit(True))
    return m.withColumn("at", at).join(full, ["rec_id", "at"], "left").where("NOT coalesce(is_section, false) OR full").select(*m.columns)


def merge(m: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by.., path, key, value): metadata of many files as one; of a key in the same section the last in ``order`` counts."""
    return _leaves(m).groupBy(*by, F.lower(F.concat_ws(".", "path")).alias("section"), F.lower("key").alias("key")).agg(F.max_by("value", order).alias("value"))


def _merge_into(out: dict, md: dict) -> None:
    names = {k.lower(): k for k in out}
    for k, v in md.items():
        k = names.setdefault(k.lower(), k)
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            _merge_into(out[k], v)
        else:
            out[k] = v


def _merge_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, rows) -> metadata rows of the files' metadata as one."""
    kinds = {"rec_id": pa.int64(), "ord": pa.int32(), "dict_ord": pa.int32(), "path": pa.list_(pa.string()), "key": pa.string(), "value": pa.string(), "vtype": pa.string(), "is_section": pa.bool_()}
    for b in batches:
        out: list[tuple] = []
        for rec_id, rows in zip(*(c.to_pylist() for c in b.columns)):
            files: dict[int, list] = {}
            for r in rows:
                files.setdefault(r["file_idx"], []).append((r["ord"], r["path"] or [], r["key"], r["value"], bool(r["is_section"])))
            first, *others = (riff.metadata_dict(files[i]) for i in sorted(files))
            for md in others:
                _merge_into(first, md)
            out += [(rec_id, *row) for row in riff.metadata_rows(first)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds.values())], names=list(kinds))


def merge_files(m: DataFrame) -> DataFrame:
    """Metadata rows of whole recordings from those (rec_id, file_idx, ord, ..) of their files.

    Keys and sections are the same in any case, spelled and placed as where they first stand; the last value by file_idx counts.
    """
    rows = m.groupBy("rec_id").agg(F.collect_list(F.struct("file_idx", "ord", "path", "key", "value", "is_section")).alias("rows"))
    return rows.mapInArrow(_merge_kernel, "rec_id bigint, ord int, dict_ord int, path array<string>, key string, value string, vtype string, is_section boolean")


def update_gain(m: DataFrame, factor: float, keys: list[str] = GAIN_KEYS) -> DataFrame:
    """Metadata with the first gain divided by ``factor``, with one digit more and without "/V"; gains without a number stay."""
    new = lookup(m, keys).select("rec_id", "ord", quantities.scaled_text(F.col("value"), factor).alias("new")).where("new IS NOT NULL")
    return _replace(m, [new])


def _shifted(value: Column, seconds: float) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(round(seconds * 1e6)), F.when(value.rlike(_ISO), value).try_cast("timestamp_ntz"))


def update_starttime(m: DataFrame, seconds: float, rate: float) -> DataFrame:
    """Metadata with all start times moved by ``seconds``, printed to whole seconds, and time references by the frames of that. A date moves with its time; what is no date and time in ISO form stays."""
    parts = []
    for k in START_KEYS:
        if len(k) == 1:
            t = _shifted(F.trim("value"), seconds)
            parts.append(find(m, k[0]).select("rec_id", "ord", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("new")))
        else:
            d, t = (find(m, x).select("rec_id", F.col("ord").alias(f"o{i}"), F.trim("value").alias(f"v{i}")) for i, x in enumerate(k))
            both = d.join(t, "rec_id").withColumn("t", _shifted(F.concat_ws("T", "v0", "v1"), seconds))
            parts += [both.select("rec_id", F.col("o0").alias("ord"), F.date_format("t", "yyyy-MM-dd").alias("new")), both.select("rec_id", F.col("o1").alias("ord"), F.date_format("t", "HH:mm:ss").alias("new"))]
    for k in REFERENCE_KEYS:
        parts.append(find(m, k).select("rec_id", "ord", (F.trim("value").try_cast("bigint") + F.rint(F.lit(seconds * rate)).cast("bigint")).cast("string").alias("new")))
    return _replace(m, [p.where("new IS NOT NULL") for p in parts])


def set_starttime(m: DataFrame, when: str) -> DataFrame:
    """Metadata with all start times that are there set to an ISO date and time."""
    day, clock = when[:10], when[11:19]
    changes = {}
    for k in START_KEYS:
        changes |= {k[0]: f"{day}T{clock}"} if len(k) == 1 else {k[0]: day, k[1]: clock}
    return set_values(m, changes)


def set_starttimes(m: DataFrame, starts: DataFrame) -> DataFrame:
    """Metadata with all start times that are there set to those of their recordings (rec_id, value TIMESTAMP_NTZ), printed to whole seconds."""
    said = F.col("start").cast("string")
    day, clock = F.substring(said, 1, 10), F.substring(said, 12, 8)
    starts = starts.select("rec_id", F.col("value").alias("start"))
    to = [(k[0], F.concat_ws("T", day, clock)) for k in START_KEYS if len(k) == 1] + [x for k in START_KEYS if len(k) == 2 for x in zip(k, (day, clock))]
    return _replace(m, [find(m, k).select("rec_id", "ord").join(starts, "rec_id").select("rec_id", "ord", new.alias("new")) for k, new in to])


def add_history(m: DataFrame, line: str, keys: list[str] = HISTORY_KEYS) -> DataFrame:
    """Metadata with a line appended, after CR LF, to every history that is there."""
    new = [find(m, k).select("rec_id", "ord", F.concat_ws("\r\n", F.when(F.col("value") != "", F.col("value")), F.lit(line)).alias("new")) for k in keys]
    return _replace(m, new)


def add_histories(m: DataFrame, lines: DataFrame, keys: list[str] = HISTORY_KEYS) -> DataFrame:
    """Metadata with a line (rec_id, line, before) for each recording appended to its histories.

    A recording without any gets CodingHistory, in section BEXT if it has one, of the lines ``before`` and ``line``, after CR LF.
    """
    mine = lines.select("rec_id", "line", "before").dropDuplicates(["rec_id"])
    first = _leaves(m).where(F.lower("key").isin([k.lower() for k in keys])).groupBy("rec_id", F.lower("key").alias("k")).agg(F.min_by(F.struct("ord", "value"), F.struct("dict_ord", "ord")).alias("f"))
    found = first.select("rec_id", "f.*").join(mine, "rec_id").select("rec_id", "ord", F.concat_ws("\r\n", F.when(F.col("value") != "", F.col("value")), "line").alias("new"))
    out = _replace(m, [found])
    bext = F.max(F.when(F.coalesce("is_section", F.lit(False)) & (F.size("path") == 0) & (F.upper("key") == "BEXT"), F.col("key")))
    has = F.max((~F.coalesce("is_section", F.lit(False)) & F.lower("key").isin([k.lower() for k in keys])).cast("int"))
    about = m.groupBy("rec_id").agg(F.max("ord").alias("o"), F.max("dict_ord").alias("d"), bext.alias("bext"), has.alias("has"))
    new = mine.join(about, "rec_id", "left").where("coalesce(has, 0) = 0")
    row = {
        "ord": F.coalesce(F.col("o") + 1, F.lit(0)).cast("int"), "dict_ord": F.when(F.col("bext").isNull(), 0).otherwise(F.col("d") + 1).cast("int"), "path": F.when(F.col("bext").isNull(), F.array().cast("array<string>")).otherwise(F.array("bext")),
        "key": F.lit("CodingHistory"), "value": F.concat_ws("\r\n", "before", "line"), "vtype": F.lit("str"), "is_section": F.lit(False),
    }
    return out.unionByName(new.select("rec_id", *[c.alias(k) for k, c in row.items()]).select(*m.columns))


def add_unwrap(m: DataFrame, thresh: float, clip: float = 0.0, unit: str = "") -> DataFrame:
    """Metadata with the unwrap threshold, and the clipped amplitude if there is one, in section INFO."""
    adds = {"INFO.UnwrapThreshold": f"{thresh:.2f}{unit}"} | ({"INFO.UnwrapClippedAmplitude": f"{clip:.2f}{unit}"} if clip > 0 else {})
    return add_values(m, adds)


def as_text(m: DataFrame, indent: int = 4) -> DataFrame:
    """(rec_id, ord, line): one line per row, indented by section, keys padded to the longest plain key of their section; line breaks are written as \\n."""
    w = Window.partitionBy("rec_id", F.concat_ws(_SEP, "path"))
    width = F.max(F.when(~F.coalesce("is_section", F.lit(False)), F.length("key"))).over(w)
    value = F.regexp_replace(F.regexp_replace(F.coalesce("value", F.lit("")), "\r", ""), "\n", "\\\\\\\\n")
    line = F.when(F.coalesce("is_section", F.lit(False)), F.concat("key", F.lit(":"))).otherwise(F.concat(F.rpad("key", F.coalesce(width, F.lit(0)).cast("int"), " "), F.lit(": "), value))
    return m.select("rec_id", "ord", F.concat(F.repeat(F.lit(" "), F.size("path") * indent), line).alias("line"))
