"""A catalog of dictionaries: seven kinds of tables as Parquet, and a manifest that says which folders are a dictionary.

Each import or change writes folders of its own and then one line of the manifest: the summary of the dictionary, with the
folder of each of its tables. The last line of a title counts. So a dictionary is replaced, or some of its rows are, while
others read: who resolved a table before goes on with the old folders whole, and a job that dies between leaves the old
line. Folders that no line needs any more go when `vacuum` is called. One writer at a time is taken for granted.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from glossaria.functions.columns import later_revision
from glossaria.operators import glossary
from glossaria.operators.lookup import is_redirect
from glossaria.sources import archive, archive_source

TABLES = ("terms", "term_meta", "kanji", "kanji_meta", "tag_meta", "media")
#: What tells rows of a table apart within a dictionary.
KEYS = {"terms": "id", "term_meta": "id", "kanji": "id", "kanji_meta": "id", "tag_meta": "tag_id", "media": "path"}
SUMMARY = (
    "title string, revision string, version int, sequenced boolean, frequency_mode string, source_language string, target_language string, index_url string, download_url string, is_updatable boolean, author string, url string, description string, "
    "attribution string, minimum_version string, styles string, import_date bigint, prefix_wildcards boolean, redirects boolean, counts map<string,bigint>, import_success boolean, builds map<string,string>, seq int, gone boolean"
)
#: Index values that a summary takes over as they are.
TAKEN = {"frequency_mode": "frequencyMode", "source_language": "sourceLanguage", "target_language": "targetLanguage", "index_url": "indexUrl", "download_url": "downloadUrl", "is_updatable": "isUpdatable", "author": "author", "url": "url", "description": "description", "attribution": "attribution", "minimum_version": "minimumYomitanVersion", "styles": "styles"}


class Catalog:
    """`program_version` is what dictionaries' minimum versions are held against; none means that all are taken."""

    def __init__(self, spark: SparkSession, path: str, program_version: str | None = None):
        self.spark, self.path, self.program_version = spark, path.rstrip("/"), program_version

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        where, store = self._at(name)
        return store.exists(where)

    def _schema(self, name: str) -> T.StructType:
        if name == "media":
            return T.StructType.fromDDL(archive_source.MEDIA)
        empty = self.spark.createDataFrame([], archive.ROW)
        made = {"terms": lambda r: archive.terms(r, reverse=True), "term_meta": archive.term_meta, "kanji": archive.kanji, "kanji_meta": archive.kanji_meta, "tag_meta": archive.tag_meta}
        return made[name](empty).schema

    def _lines(self) -> DataFrame:
        return self.spark.read.schema(SUMMARY).parquet(f"{self.path}/dictionaries") if self._exists("dictionaries") else self.spark.createDataFrame([], SUMMARY)

    def _note(self, line: dict) -> None:
        names = [f.name for f in T.StructType.fromDDL(SUMMARY)]
        row = self.spark.createDataFrame([tuple(line.get(n) for n in names)], SUMMARY)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/dictionaries")

    def info(self) -> DataFrame:
        """Summaries of all dictionaries, as they are now."""
        last = Window.partitionBy("title").orderBy(F.desc("seq"))
        return self._lines().withColumn("_n", F.row_number().over(last)).where("_n = 1 and not gone").drop("_n")

    def summary(self, title: str) -> dict | None:
        found = self.info().where(F.col("title") == title).first()
        return found.asDict() if found else None

    def has(self, title: str) -> bool:
        return self.summary(title) is not None

    def table(self, name: str, titles: list[str] | None = None) -> DataFrame:
        """Rows of one kind: of all dictionaries, or of some, whose folders alone are read. `dictionaries` has the summaries."""
        if name == "dictionaries":
            return self.info()
        own = self.info() if titles is None else self.info().where(F.col("title").isin(titles))
        folders = [r[0] for r in own.select(F.col("builds")[name]).where(F.col("builds")[name].isNotNull()).collect()]  # one a dictionary
        schema = self._schema(name)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _build(self, name: str, rows: DataFrame) -> str:
        folder = f"build-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}/{folder}")
        return folder

    def _counted(self, name: str, folder: str) -> dict[str, int]:
        own = self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}/{folder}")
        counts = {name: own.count()}
        if "mode" in own.columns:
            counts |= {f"{name}.{r['mode']}": r["count"] for r in own.groupBy("mode").count().collect()}
        return counts

    def import_archive(self, path: str, replace: bool = False) -> dict:
        """Check all banks of one archive, write its tables, then its line. A title that is there already, unless it is to
        be replaced, or a bank with wrong rows, raises before anything is written; a missing image leaves the summary as
        not successful."""
        index = archive_source.index(path)
        least = index.get("minimumYomitanVersion")
        if self.program_version and isinstance(least, str) and self.spark.range(1).select(later_revision(F.lit(self.program_version), F.lit(least))).first()[0]:
            raise archive.ArchiveError(f"Dictionary {index['title']} needs version {least}")
        old = self.summary(index["title"])
        if old and not replace:
            raise archive.ArchiveError(f"Dictionary {index['title']} is already imported")
        rows = archive_source.banks(self.spark, path)
        wrong = archive.invalid_rows(rows).limit(5).collect()
        if wrong:
            raise archive.ArchiveError("; ".join(f"{r['bank']} {r['file_no']}:{r['row_no']} {r['reason']}" for r in wrong))
        terms = archive.terms(rows, reverse=True)
        paths = glossary.image_requirements(terms).select("dictionary", "path").distinct()
        media = archive_source.media(self.spark, path).join(paths, ["dictionary", "path"], "left_semi").select(*(f.name for f in self._schema("media")))
        found = {"terms": terms, "term_meta": archive.term_meta(rows), "kanji": archive.kanji(rows), "kanji_meta": archive.kanji_meta(rows), "tag_meta": archive.tag_meta(rows), "media": media}
        old_tags = archive.old_index_tags(index)
        if old_tags and not rows.where("bank = 'tag'").isEmpty():  # they come with a tag bank only
            tags = self.spark.createDataFrame([(-1 - k, index["title"], *t) for k, t in enumerate(old_tags)], found["tag_meta"].schema)
            found["tag_meta"] = found["tag_meta"].unionByName(tags)
        builds = {name: self._build(name, df) for name, df in found.items()}
        counts = {k: n for name, folder in builds.items() for k, n in self._counted(name, folder).items()}
        ok = counts["media"] == paths.count()
        written = self.spark.read.schema(self._schema("terms")).parquet(f"{self.path}/terms/{builds['terms']}")
        line = {k: index.get(v) for k, v in TAKEN.items()} | {"title": index["title"], "revision": index["revision"], "version": index["version"], "sequenced": index.get("sequenced") is True, "import_date": int(time.time() * 1000), "prefix_wildcards": True}
        redirects = not written.where(F.exists("definitions", is_redirect)).isEmpty()
        self._note(line | {"redirects": redirects, "counts": counts, "import_success": ok, "builds": builds, "seq": (old["seq"] + 1) if old else self._next(index["title"]), "gone": False})
        return {"title": index["title"], "counts": counts, "success": ok}

    def _next(self, title: str) -> int:
        return (self._lines().where(F.col("title") == title).agg(F.max("seq")).first()[0] or 0) + 1

    def upsert(self, title: str, name: str, rows: DataFrame) -> dict[str, int]:
        """Put rows into a dictionary's table: those whose key is there already take the place of the old ones, others are
        added. Gives how many were updated and added. Rows with a key twice are an error."""
        old = self.summary(title)
        if not old:
            raise KeyError(title)
        key, schema = KEYS[name], self._schema(name)
        new = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema if f.name != "dictionary"), F.lit(title).alias("dictionary")).select(*schema.names)
        have = self.table(name, [title])
        folder = self._build(name, have.join(new.select(key), key, "left_anti").select(*schema.names).unionByName(new))
        made = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{folder}")
        before, after, given = have.count(), made.count(), new.count()
        if made.select(key).distinct().count() != after:
            raise ValueError(f"{name}: a key stands in more than one row")
        counts = {k: n for k, n in old["counts"].items() if k != name and not k.startswith(f"{name}.")} | self._counted(name, folder)
        self._note(old | {"builds": old["builds"] | {name: folder}, "counts": counts, "seq": old["seq"] + 1, "redirects": old["redirects"] or (name == "terms" and not made.where(F.exists("definitions", is_redirect)).isEmpty())})
        return {"added": after - before, "updated": given - (after - before)}

    def delete(self, title: str) -> None:
        """From its line on the dictionary is gone; its folders go by `vacuum`, when nobody reads them."""
        old = self.summary(title)
        if old:
            self._note(old | {"seq": old["seq"] + 1, "gone": True})

    def vacuum(self) -> list[str]:
        """Delete folders that no dictionary needs: of replaced tables, deleted dictionaries and jobs that died."""
        needed = {f"{name}/{folder}" for r in self.info().select("builds").collect() for name, folder in r["builds"].items()}
        gone = []
        for name in TABLES:
            where, store = self._at(name)
            for status in store.listStatus(where) if store.exists(where) else []:
                folder = f"{name}/{status.getPath().getName()}"
                if folder not in needed:
                    self._drop(folder)
                    gone.append(folder)
        return gone

    def purge(self) -> None:
        for name in (*TABLES, "dictionaries"):
            self._drop(name)

    def _drop(self, name: str) -> None:
        where, store = self._at(name)
        store.delete(where, True)

    def counts(self) -> DataFrame:
        """dictionary and a column of each table's rows."""
        return dictionary_counts({n: self.table(n) for n in TABLES})

    def media(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.table("media"), ["dictionary", "path"])


def dictionary_counts(tables: dict[str, DataFrame]) -> DataFrame:
    each = [df.groupBy("dictionary").count().withColumn("table", F.lit(n)) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, each).groupBy("dictionary").pivot("table", list(tables)).sum("count").fillna(0)


def updates(installed: DataFrame, remote: DataFrame) -> DataFrame:
    """title, has_update: by the revisions of a table of remote indexes (index_url, revision); none means no update."""
    met = installed.join(remote.withColumnRenamed("revision", "latest"), "index_url", "left")
    return met.select("title", F.coalesce(later_revision(F.col("revision"), F.col("latest")), F.lit(False)).alias("has_update"))


ENABLED = T.StructType([T.StructField("title", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("alias", T.StringType()), T.StructField("allow_secondary", T.BooleanType()), T.StructField("pos_filter", T.BooleanType()), T.StructField("use_deinflections", T.BooleanType())])


def enabled_map(spark: SparkSession, titles: list[str], pos_filter: bool = True) -> DataFrame:
    return spark.createDataFrame([(t, k, t, True, pos_filter, True) for k, t in enumerate(titles)], ENABLED)
