"""Trees of definitions against a recursive version, and the archive source against what zip files hold."""

import json
import random
import re
import struct
import zipfile

import pytest

from glossaria.operators import glossary
from glossaria.sources import archive_source
from glossaria.sources.catalog import Catalog

LINES = ("li", "div", "ol", "ul", "table", "thead", "tbody", "tfoot", "tr", "details", "summary")


def parts(node):
    if isinstance(node, str):
        return [node]
    if isinstance(node, list):
        return [p for x in node for p in parts(x)]
    if not isinstance(node, dict) or node.get("tag") in ("rt", "rp"):
        return []
    if node.get("tag") == "br":
        return ["\n"]
    inner = parts(node["content"]) if "content" in node else []
    tag = node.get("tag")
    return inner + (["\n"] if tag in LINES else [" "] if tag in ("td", "th") else [])


def said(definition):
    try:
        node = json.loads(definition)
    except ValueError:
        return definition
    if not isinstance(node, dict) or node.get("type") not in ("text", "image", "structured-content"):
        return definition
    if node["type"] != "structured-content":
        return node.get("text", "") if node["type"] == "text" else ""
    text = re.sub(r"[ \t]+\n", "\n", "".join(parts(node.get("content"))))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def images(node, found):
    if isinstance(node, list):
        for x in node:
            images(x, found)
    elif isinstance(node, dict):
        if node.get("tag") == "img":
            found.append(node["path"])
        elif node.get("tag") not in ("rt", "rp", "br"):
            images(node.get("content"), found)
    return found


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["word", " two  words ", "", "line\n", 7, None, True, '{"tag":"br"}', "[1]", "日本 "])
    if kind < 0.55:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    tag = rng.choice([*LINES, "td", "th", "br", "rt", "rp", "ruby", "span", "a", "img", "unknown"])
    node = {"tag": tag} | ({"path": f"{rng.randrange(5)}.png", "width": 3, "title": 5} if tag == "img" else {})
    if rng.random() < 0.9 and tag != "img":
        node["content"] = tree(rng, depth - 1)
    return node


TERM = "dictionary string, id long, definitions array<string>"


def terms_of(spark, rows):
    return spark.createDataFrame([("A", k, d) for k, d in enumerate(rows)], TERM)


def test_plain_texts_of_trees(spark):
    rng = random.Random(3)
    rows = [["plain", "[not json", '["redirect", ["x"]]', '{"type": "other"}', "{broken"], [json.dumps({"type": "text", "text": " as it is \n"})], [json.dumps({"type": "image", "path": "a.png"})], [], None, [json.dumps({"type": "structured-content"})]]
    rows += [[json.dumps({"type": "structured-content", "content": tree(rng, rng.randrange(7))}, ensure_ascii=False) for _ in range(rng.randrange(4))] for _ in range(120)]
    deep = "end"
    for k in range(25):
        deep = {"tag": ("div", "span", "li")[k % 3], "content": [f"{k} ", deep]}
    rows.append([json.dumps({"type": "structured-content", "content": deep})])
    got = {(r["id"], r["k"]): r["text"] for r in glossary.plain_definitions(terms_of(spark, rows)).collect()}
    assert got == {(k, j): said(d) for k, ds in enumerate(rows) for j, d in enumerate(ds or [])}
    assert glossary.plain_definitions(terms_of(spark, rows).limit(0)).count() == 0


def test_images_of_trees(spark):
    rng = random.Random(4)
    rows = [[json.dumps({"type": "image", "path": "top.png", "width": 10, "alt": "x", "pixelated": "no"})]] + [[json.dumps({"type": "structured-content", "content": tree(rng, 6)})] for _ in range(80)]
    found = glossary.image_requirements(terms_of(spark, rows)).orderBy("id", "k", "way").collect()
    expected = [(0, "top.png")] + [(k, p) for k, ds in enumerate(rows) if k for p in images(json.loads(ds[0])["content"], [])]
    assert [(r["id"], r["path"]) for r in found] == expected
    assert (found[0]["preferred_width"], found[0]["alt"], found[0]["pixelated"]) == (10.0, "x", None)
    assert all(r["preferred_width"] == 3.0 and r["title"] is None for r in found[1:])


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x06\0\0\0"


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00"


def write_archive(path, title, files, **index):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("index.json", json.dumps({"title": title, "revision": "1", "format": 3} | index))
        for name, content in files.items():
            z.writestr(name, content if isinstance(content, bytes) else json.dumps(content, ensure_ascii=False))


@pytest.fixture
def zips(tmp_path):
    folder = tmp_path / "zips"
    folder.mkdir()
    for title, n in (("A", 3), ("B", 1)):
        banks = {f"term_bank_{k}.json": [[f"{title}{k}語{j}", "", "", "", 0, ["x"], j, ""] for j in range(40)] for k in range(n)}
        content = {"type": "structured-content", "content": [{"tag": "img", "path": "img/a.png"}, {"tag": "img", "path": "gone.gif"}, {"tag": "img", "path": "b.jpg"}]}
        banks["term_bank_9.json"] = [["画", "え", "", "n", 0, [content], 1, ""]]
        write_archive(folder / f"{title}.zip", title, banks | {"tag_bank_1.json": [["n", "partOfSpeech", 1, "noun", 0]], "img/a.png": png(30, 20), "b.jpg": JPEG, "unused.png": png(1, 1), "nested/term_bank_1.json": [[1]]})
    return folder


def test_banks_are_partitions(spark, zips):
    rows = archive_source.banks(spark, str(zips))
    assert rows.rdd.getNumPartitions() == 8  # three and one term banks, one of images and one of tags in each
    got = {(r["dictionary"], r["bank"], r["file_no"], r["row_no"], json.loads(r["row"])[0]) for r in rows.collect()}
    expected = {(t, "term", k, j, f"{t}{k}語{j}") for t, n in (("A", 3), ("B", 1)) for k in range(n) for j in range(40)}
    assert got == expected | {(t, "term", 9, 0, "画") for t in "AB"} | {(t, "tag", 1, 0, "n") for t in "AB"}
    tags = archive_source.banks(spark, str(zips / "A.zip"), ["tag"])
    assert tags.rdd.getNumPartitions() == 1 and tags.count() == 1


def test_media_with_sizes(spark, zips):
    found = archive_source.media(spark, str(zips / "A.zip"))
    assert sorted((r["path"], r["media_type"], r["width"], r["height"], len(r["content"])) for r in found.collect()) == [("b.jpg", "image/jpeg", 9, 7, len(JPEG)), ("img/a.png", "image/png", 30, 20, len(png(1, 1))), ("unused.png", "image/png", 1, 1, len(png(1, 1)))]
    cut_off = archive_source.image_size(b"\x89PNG\r\n")
    assert cut_off == (None, None) and archive_source.image_size(b"GIF89a\x05\x00\x06\x00") == (5, 6) and archive_source.image_size(b"") == (None, None)


def test_bad_archives_are_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("term_bank_1.json", "[]")
    with pytest.raises(Exception, match="No dictionary index"):
        archive_source.banks(spark, str(tmp_path / "n.zip")).count()


def test_import_reads_banks_and_resolves_images(spark, zips, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    done = cat.import_archive(str(zips / "A.zip"))
    assert done["counts"]["terms"] == 121 and done["counts"]["media"] == 2 and done["success"] is False  # one image is missing
    needed = glossary.resolved_images(glossary.image_requirements(cat.table("terms")), cat.table("media")).orderBy("way").collect()
    assert [(r["path"], r["found"], r["width"], r["height"]) for r in needed] == [("img/a.png", True, 30, 20), ("gone.gif", False, None, None), ("b.jpg", True, 9, 7)]
