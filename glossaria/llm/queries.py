"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossaria.llm import bpe, conversations, decontam, divergence, exact_dedup, license_scan, line_dedup, minhash, quality, sharding, substring_index, suffix_dedup, url_filter
from glossaria.llm.common import of_scan

#: The contract's url rules.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)

#: The contract's phrases, and the wording of well-known licenses or of the notices that point to them.
LICENSES = (
    license_scan.Template("gpl", "gnu general public license", True),
    license_scan.Template("apache", "apache license", True),
    license_scan.Template("cc-by", "cc by", True),
    license_scan.Template("mit", "mit license", True),
    license_scan.Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    license_scan.Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
the License for the specific language governing permissions and limitations under the License."""),
    license_scan.Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE
IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    license_scan.Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    license_scan.Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    license_scan.Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    license_scan.Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means."""),
    license_scan.Template("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan, with row numbers."""
    return of_scan(table(spark, sf_dir, "documents"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.deduplicate(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("digest", F.sha2("kept", 256)).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarise(license_scan.scan(documents(spark, sf_dir), LICENSES))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_index.deduplicate(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.coalesce("digest", F.sha2("kept", 256)).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe_path()
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", "n_linked", F.coalesce("digest", F.sha2("kept", 256)).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judge(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(of_scan(table(spark, sf_dir, "conversations")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = exact_dedup.deduplicate(documents(spark, sf_dir))
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_url_filter, op2_suffix_dedup, op3_quality, op4_license_scan, op5_substring_dedup, op6_bpe, op7_line_dedup, op8_decontaminate, op9_near_dedup, op10_shard,
        op11_conversation_repair, op12_source_divergence, op13_exact_dedup,
    )
    return {f.__name__: f for f in every}


URL_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parsed AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT any_value(page_id) AS page_id, any_value(p.host) AS host, any_value(p.path) AS path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule, coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM parsed p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY rid
"""

SUFFIX_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, doc_id, k, md5(substr(h, 2 * k + 1, 100)) AS s FROM (SELECT rid, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM d)),
dup AS (SELECT rid, k FROM (SELECT rid, doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + 50)) AS p FROM dup),
spans AS (SELECT rid, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM gone) GROUP BY rid),
each AS (SELECT rid, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE rid IN (SELECT rid FROM spans)),
kept AS (SELECT each.rid, string_agg(substr(h, 2 * each.p + 1, 2), '' ORDER BY each.p) AS k FROM each LEFT JOIN gone ON gone.rid = each.rid AND gone.p = each.p WHERE gone.p IS NULL GROUP BY each.rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (rid) LEFT JOIN kept USING (rid)
"""

DECONTAM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, dw.n, k, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def _license_sql() -> str:
    rows = ", ".join(f"({k}, '{t.label}', {t.phrase}, string_split('{' '.join(t.words)}', ' '), {t.stride})" for k, t in enumerate(LICENSES))
    return rf"""
WITH t AS (SELECT *, list_distinct(ws) AS tokens, CASE WHEN phrase THEN len(list_distinct(ws)) ELSE ceil({license_scan.THRESHOLD} * len(list_distinct(ws)) - 1e-9) END AS need FROM (VALUES {rows}) v(k, label, phrase, ws, stride)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT rid, stride, s, w[s + 1 : s + 2 * stride] AS block FROM (SELECT rid, w, stride, unnest(range(0, len(w), stride)) AS s FROM d, (SELECT DISTINCT stride FROM t))),
met AS (SELECT rid, s, block, label, phrase, ws, t.stride AS stride, len(list_intersect(list_distinct(block), tokens)) / len(tokens) AS containment
  FROM b JOIN t ON b.stride = t.stride WHERE len(list_intersect(list_distinct(block), tokens)) >= need),
places AS (SELECT rid, label, s + i AS place, containment FROM (SELECT *, unnest(range(0, least(len(block), stride))) AS i FROM met WHERE phrase) WHERE block[i + 1 : i + len(ws)] = ws),
p AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
  FROM (SELECT rid, label, containment FROM places UNION ALL SELECT rid, label, containment FROM met WHERE NOT phrase) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN p USING (rid) LEFT JOIN l USING (rid)
"""


SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, k, sha256(array_to_string(w[k : k + 19], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d)),
seen AS (SELECT rid, k, (doc_id, k) > min((doc_id, k)) OVER (PARTITION BY h) AS later FROM win),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + 20)) AS p FROM seen WHERE later),
w AS (SELECT rid, doc_id, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT w.rid, count(*) FILTER (g.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept FROM w LEFT JOIN gone g ON w.rid = g.rid AND w.p = g.p GROUP BY w.rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM dense JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


EXACT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, rid = first_value(rid) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY doc_id NULLS FIRST, rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_source_divergence": DIVERGENCE_SQL, "op13_exact_dedup": EXACT_SQL, "op1_url_filter": URL_SQL, "op2_suffix_dedup": SUFFIX_SQL, "op4_license_scan": _license_sql(), "op5_substring_dedup": SUBSTRING_SQL, "op8_decontaminate": DECONTAM_SQL}
