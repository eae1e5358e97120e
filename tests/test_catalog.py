"""Replacing dictionaries and rows while others read, and what summaries keep."""

import pytest
from test_glossary import write_archive

from glossaria.sources import archive
from glossaria.sources.catalog import Catalog
from pyspark.sql import functions as F


def term(word, said, number=1):
    return [word, "", "", "", 0, [said], number, ""]


@pytest.fixture
def catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    write_archive(tmp_path / "a.zip", "A", {"term_bank_1.json": [term("one", "1"), term("two", "2")], "term_meta_bank_1.json": [["one", "freq", 3]]}, author="somebody", isUpdatable=True, indexUrl="https://x.example/i", downloadUrl="https://x.example/d", sequenced=True)
    write_archive(tmp_path / "b.zip", "B", {"term_bank_1.json": [term("other", '["one", ["x"]]')], "styles.css": b"p {}"})
    cat.import_archive(str(tmp_path / "a.zip"))
    cat.import_archive(str(tmp_path / "b.zip"))
    return cat


def said(df):
    return sorted((r["dictionary"], r["expression"], r["definitions"][0]) for r in df.collect())


def test_summaries(catalog):
    a, b = catalog.summary("A"), catalog.summary("B")
    assert (a["author"], a["is_updatable"], a["download_url"], a["sequenced"], a["redirects"], a["styles"]) == ("somebody", True, "https://x.example/d", True, False, "")
    assert (b["styles"], b["redirects"], b["counts"]["terms"], b["is_updatable"]) == ("p {}", True, 1, None)
    assert catalog.summary("C") is None and catalog.table("kanji").count() == 0


def test_a_reader_that_began_before_sees_the_old_one_whole(catalog, tmp_path):
    before = catalog.table("terms")
    write_archive(tmp_path / "a2.zip", "A", {"term_bank_1.json": [term("one", "new")]})
    with pytest.raises(archive.ArchiveError, match="already"):
        catalog.import_archive(str(tmp_path / "a2.zip"))
    catalog.import_archive(str(tmp_path / "a2.zip"), replace=True)
    assert said(before) == [("A", "one", "1"), ("A", "two", "2"), ("B", "other", '["one", ["x"]]')]
    assert said(catalog.table("terms")) == [("A", "one", "new"), ("B", "other", '["one", ["x"]]')]
    assert said(catalog.table("terms", ["A"])) == [("A", "one", "new")] and catalog.table("term_meta").count() == 0
    assert len(catalog.vacuum()) == 6 and catalog.vacuum() == []
    assert said(catalog.table("terms", ["A"])) == [("A", "one", "new")]


def test_a_job_that_dies_between_leaves_the_old_one(catalog, tmp_path, monkeypatch):
    write_archive(tmp_path / "a2.zip", "A", {"term_bank_1.json": [term("one", "new")]})
    monkeypatch.setattr(catalog, "_note", lambda line: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        catalog.import_archive(str(tmp_path / "a2.zip"), replace=True)
    monkeypatch.undo()
    assert said(catalog.table("terms", ["A"])) == [("A", "one", "1"), ("A", "two", "2")]
    assert len(catalog.vacuum()) == 6 and said(catalog.table("terms", ["A"])) == [("A", "one", "1"), ("A", "two", "2")]


def test_rows_are_updated_and_added(spark, catalog):
    have = catalog.table("terms", ["A"])
    old = catalog.table("terms")
    new = have.where("expression = 'two'").withColumn("definitions", F.array(F.lit("changed")))
    new = new.unionByName(new.withColumns({"id": F.lit(999), "expression": F.lit("three")}))
    assert catalog.upsert("A", "terms", new.drop("dictionary")) == {"added": 1, "updated": 1}
    assert said(catalog.table("terms", ["A"])) == [("A", "one", "1"), ("A", "three", "changed"), ("A", "two", "changed")]
    assert catalog.summary("A")["counts"]["terms"] == 3 and catalog.summary("A")["counts"]["term_meta.freq"] == 1
    assert said(old)[:2] == [("A", "one", "1"), ("A", "two", "2")]
    with pytest.raises(ValueError, match="more than one row"):
        catalog.upsert("A", "terms", new.unionByName(new).drop("dictionary"))
    with pytest.raises(KeyError):
        catalog.upsert("C", "terms", new.drop("dictionary"))
    assert catalog.table("terms", ["A"]).count() == 3


def test_deleted_and_imported_again(catalog, tmp_path):
    catalog.delete("A")
    assert not catalog.has("A") and said(catalog.table("terms")) == [("B", "other", '["one", ["x"]]')]
    catalog.import_archive(str(tmp_path / "a.zip"))
    assert said(catalog.table("terms", ["A"])) == [("A", "one", "1"), ("A", "two", "2")]


def test_index_values(spark, tmp_path):
    for k, (index, error) in enumerate([({"isUpdatable": True}, "updatable"), ({"isUpdatable": False, "indexUrl": "https://a.b/", "downloadUrl": "https://a.b/"}, "updatable"), ({"isUpdatable": True, "indexUrl": "ftp://a/b", "downloadUrl": "https://a.b/"}, "updatable"), ({"minimumYomitanVersion": "24.5.1"}, "needs version")]):
        write_archive(tmp_path / f"{k}.zip", str(k), {"term_bank_1.json": []}, **index)
        with pytest.raises(archive.ArchiveError, match=error):
            Catalog(spark, str(tmp_path / "c"), program_version="24.5.0").import_archive(str(tmp_path / f"{k}.zip"))
    assert archive.AUDIO_EXTENSIONS["audio/x-wav"] == ".wav"
