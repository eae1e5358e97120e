"""Dictionary archives: zip files of JSON banks, whose rows are turned into typed tables.

Rows come from `archive_source`, a bank a task, as positional JSON arrays that are projected by place. All banks are
checked before anything is returned.
"""

from __future__ import annotations

import io
import json
import zipfile
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, functions as F

from glossaria.functions.columns import reversed_text, split_field

# Names of banks in an archive's root, and how many values their rows have.
BANKS = {"term": r"^term_bank_(\d+)\.json$", "term_meta": r"^term_meta_bank_(\d+)\.json$", "kanji": r"^kanji_bank_(\d+)\.json$", "kanji_meta": r"^kanji_meta_bank_(\d+)\.json$", "tag": r"^tag_bank_(\d+)\.json$"}
ROW_SIZES = {"term": 8, "term_meta": 3, "kanji": 6, "kanji_meta": 3, "tag": 5}
MODES = {"term_meta": ("freq", "pitch", "ipa"), "kanji_meta": ("freq",)}
# Media types by file name extension.
MEDIA_TYPES = {"apng": "image/apng", "avif": "image/avif", "bmp": "image/bmp", "gif": "image/gif", "ico": "image/x-icon", "cur": "image/x-icon", **dict.fromkeys("jpg jpeg jfif pjpeg pjp".split(), "image/jpeg"), "png": "image/png", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}
# File name extensions of audio by media type.
AUDIO_EXTENSIONS = {
    **dict.fromkeys(("audio/mpeg", "audio/mp3"), ".mp3"), **dict.fromkeys(("audio/ogg", "audio/vorbis", "application/ogg"), ".ogg"), "audio/aac": ".aac", "audio/mp4": ".mp4", "audio/flac": ".flac", "audio/webm": ".webm",
    **dict.fromkeys(("audio/vnd.wav", "audio/wave", "audio/wav", "audio/x-wav", "audio/x-pn-wav"), ".wav"),
}

#: Of rows of version 1, whose last values are the definitions or meanings.
LEAST_SIZES = {"term": 5, "kanji": 4}
#: Kinds of values by their place, as Spark names the types of JSON values.
NUMBER, ARRAY, OBJECT = "^(BIGINT|DOUBLE|DECIMAL)", "^ARRAY", "^(OBJECT|STRUCT)"
KINDS = {("term", None): {4: NUMBER}, ("term", 3): {5: ARRAY, 6: NUMBER}, ("kanji", 3): {4: ARRAY, 5: OBJECT}, ("tag", None): {2: NUMBER, 4: NUMBER}}


ROW = "dictionary string, version int, bank string, file_no int, row_no int, row string"


class ArchiveError(ValueError):
    pass


def read_index(data: bytes) -> dict:
    """The index of an archive that is held as bytes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return index_of(z)


def index_of(z: zipfile.ZipFile) -> dict:
    """An archive's index; `format` goes before `version`. Dictionaries that can be updated say where from."""
    names = z.namelist()
    if "index.json" not in names:
        nested = [n for n in names if n.endswith("/index.json")]
        raise ArchiveError("No dictionary index found in archive" + (f"; redundant directory {nested[0].rpartition('/')[0]}" if nested else ""))
    index = json.loads(z.read("index.json"))
    version = index.get("format", index.get("version"))
    if not isinstance(index.get("title"), str) or not isinstance(index.get("revision"), str) or version not in (1, 2, 3):
        raise ArchiveError("Invalid dictionary index: title, revision and format 1 to 3 are needed")
    if index.get("frequencyMode", "rank-based") not in ("occurrence-based", "rank-based"):
        raise ArchiveError(f"Invalid frequency mode {index['frequencyMode']}")
    if isinstance(index.get("isUpdatable"), bool):
        places = [urlsplit(u) if isinstance(u := index.get(name), str) else None for name in ("indexUrl", "downloadUrl")]
        if not index["isUpdatable"] or not all(p and p.scheme in ("http", "https") and p.netloc for p in places):
            raise ArchiveError("Invalid index data for updatable dictionary")
    return index | {"version": version}


def old_index_tags(index: dict) -> list[tuple]:
    """Tags that an old index holds itself: name, category, order, notes, score."""
    found = index.get("tagMeta")
    known = lambda v: (v.get("category"), float(v.get("order") or 0), v.get("notes"), float(v.get("score") or 0))
    return [(name, *known(v)) for name, v in found.items()] if isinstance(found, dict) else []


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Rows that a bank may not have, with the reason."""
    size = F.json_array_length("row")
    first = lambda k: F.get_json_object("row", f"$[{k}]")
    wrong_size = F.lit(False)
    for bank, n in ROW_SIZES.items():
        own = size != n if bank not in ("term", "kanji") else F.when(F.col("version") == 1, size < LEAST_SIZES[bank]).otherwise(size != n)
        wrong_size = wrong_size | ((F.col("bank") == bank) & own)
    wrong_mode = F.lit(False)
    for bank, modes in MODES.items():
        wrong_mode = wrong_mode | ((F.col("bank") == bank) & ~F.coalesce(first(1).isin(*modes), F.lit(False)))
    value, wrong_kind = F.try_parse_json("row"), F.lit(False)
    for (bank, version), kinds in KINDS.items():
        own = (F.col("bank") == bank) & (F.lit(version is None) | (F.col("version") == F.lit(version)))
        for k, kind in kinds.items():
            named = F.schema_of_variant(F.try_variant_get(value, f"$[{k}]", "variant"))
            wrong_kind = wrong_kind | (own & ~F.coalesce(named.rlike(kind), F.lit(False)))
    reason = F.when(size.isNull(), "not an array").when(wrong_size, "number of values").when(wrong_mode, "mode").when(wrong_kind, "kind of value").when(first(0).isNull(), "no name")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def _at(k: int) -> Column:
    return F.get_json_object("row", f"$[{k}]")


def _list_from(k: int) -> Column:
    """Values from the k-th on, as JSON texts."""
    return F.slice(F.from_json("row", "array<string>"), k + 1, 1 << 20)


def _id() -> Column:
    """Place in the archive: file, then row."""
    return (F.col("file_no").cast("long") * F.lit(1 << 32) + F.col("row_no")).alias("id")


def terms(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """Term rows; an empty reading is the expression."""
    own = rows.where(F.col("bank") == "term")
    reading = F.when(F.length(_at(1)) > 0, _at(1)).otherwise(_at(0))
    old = F.col("version") == 1
    out = own.select(
        _id(), "dictionary", _at(0).alias("expression"), reading.alias("reading"), split_field(_at(2)).alias("definition_tags"), split_field(_at(3)).alias("rules"), _at(4).cast("double").alias("score"),
        F.when(old, _list_from(5)).otherwise(F.from_json(_at(5), "array<string>")).alias("definitions"),
        F.coalesce(F.when(~old, _at(6).cast("long")), F.lit(-1)).alias("sequence"), F.when(old, F.array().cast("array<string>")).otherwise(split_field(_at(7))).alias("term_tags"),
    )
    return out.withColumns({"expression_reverse": reversed_text(F.col("expression")), "reading_reverse": reversed_text(F.col("reading"))}) if reverse else out


def term_meta(rows: DataFrame) -> DataFrame:
    own = rows.where(F.col("bank") == "term_meta")
    return own.select(_id(), "dictionary", _at(0).alias("expression"), _at(1).alias("mode"), _at(2).alias("data"), F.get_json_object(_at(2), "$.reading").alias("meta_reading"))


def kanji(rows: DataFrame) -> DataFrame:
    own, old = rows.where(F.col("bank") == "kanji"), F.col("version") == 1
    return own.select(
        _id(), "dictionary", _at(0).alias("character"), split_field(_at(1)).alias("onyomi"), split_field(_at(2)).alias("kunyomi"), split_field(_at(3)).alias("tags"),
        F.when(old, _list_from(4)).otherwise(F.from_json(_at(4), "array<string>")).alias("meanings"), F.when(~old, F.from_json(_at(5), "map<string,string>")).alias("stats"),
    )


def kanji_meta(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("bank") == "kanji_meta").select(_id(), "dictionary", _at(0).alias("character"), _at(1).alias("mode"), _at(2).alias("data"))


def tag_meta(rows: DataFrame) -> DataFrame:
    own = rows.where(F.col("bank") == "tag")
    return own.select(_id().alias("tag_id"), "dictionary", _at(0).alias("name"), _at(1).alias("category"), _at(2).cast("double").alias("order"), _at(3).alias("notes"), _at(4).cast("double").alias("score"))
