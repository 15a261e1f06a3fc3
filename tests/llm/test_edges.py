"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: one test for each operator and stage."""

import pytest
from conftest import DATA, check_same
from folioframe.llm import decontamination, langid, licenses, linededup, mixing, quality, revisits, simhash, sstable, winnowing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = " ".join(f"word{i % 97} thing{i % 89}" for i in range(300))
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))


@pytest.fixture(scope="module")
def messy(spark):
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, "a", 4),
        (4, WORDS, "en", "a", len(WORDS)),
        (4, WORDS, "en", "a", len(WORDS)),
        (5, WORDS, "de", None, len(WORDS)),
        (None, WORDS, None, "b", None),
        (None, None, None, None, None),
        (6, LONG, "en", "b", len(LONG)),
        (7, "x", "", "", 1),
        (8, "ÉÀß 日本語 \U0001f600 'tis", "fr", "b", 20),
        (9, "...!!!", "en", "b", 6),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(messy):
    """The same rows with columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    for name in "key row h_key h_hits hits_of_text hi lo at part rows nth id_ no_id m_source m_key m_row m_tokens m_epoch m_copies epochs cut c_source probability keep action host".split():
        messy = messy.withColumn(name, F.lit(name))
    return messy


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(WORDS.split()[40:70])), (2, None), (3, ""), (4, "Tiny item")], "item_id bigint, text string")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, None, None]


def test_licenses(messy, none):
    frequencies, n = licenses.document_frequencies(messy, ["word1", "absent"])
    assert n == 12 and frequencies == {"word1": 4, "absent": 0}
    out = licenses.scan_documents(messy)
    assert ids(out) == ALL and all(not r.licenses and not r.matches for r in out.collect())
    assert licenses.scan_documents(none).count() == 0


def test_licenses_repeat_and_overlap(spark):
    text = "x " * 30 + "Licensed under the Apache License, Version 2.0. " + "y " * 20 + "LICENSED under the APACHE license version 2 0 " + "All rights reserved"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "the license of apache version 2")], "doc_id bigint, text string")
    out = licenses.scan_documents(docs).orderBy("doc_id").collect()
    assert [r.licenses for r in out] == [["Apache-2.0", "Proprietary"]] * 2 + [[]]
    assert [(m.license, m.first_word) for m in out[0].matches] == [("Apache-2.0", 30), ("Apache-2.0", 58), ("Proprietary", 66)]


def test_licence_versions(spark):
    notice = "x " * 30 + "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {}. " + "y " * 30
    gpl, lgpl, agpl = (f"{name}General Public License" for name in ("", "Lesser ", "Affero "))
    later = "either version {} of the License, or (at your option) any later version"
    cases = [(gpl, later.format(2), ["GPL-2.0"]), (gpl, later.format(3), ["GPL-3.0"]), (lgpl, later.format(2), ["LGPL-2.0"]), (lgpl, later.format(2.1), ["LGPL-2.1"]), (lgpl, later.format(3), ["LGPL-3.0"]), (agpl, later.format(3), ["AGPL-3.0"])]
    cases += [(lgpl, "version 2.1 of the License", ["LGPL-2.1"]), (lgpl, "version 3", ["LGPL-3.0"]), (agpl, "version 3 of the License", ["AGPL-3.0"]), (agpl, later.format(1), [])]
    docs = spark.createDataFrame([(i, notice.format(name, version)) for i, (name, version, _) in enumerate(cases)], "doc_id bigint, text string")
    assert [r.licenses for r in licenses.scan_documents(docs).orderBy("doc_id").collect()] == [x for _, _, x in cases]


def test_winnowing(messy, none):
    out = {(r.doc_id, r.n_fingerprints) for r in winnowing.winnow(messy).collect()}
    assert ids(winnowing.winnow(messy)) == ALL
    assert {(1, 0), (2, 0), (3, 0), (7, 0), (8, 0), (9, 0)} <= out and dict(out)[6] > 1000
    assert winnowing.winnow(none).count() == 0


def test_quality(spark, messy, none, clashing):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 0), (5, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    net = quality.fit(messy, labels)
    out = quality.classify(messy, net)
    assert ids(out) == ALL
    assert {(r.doc_id, r.probability) for r in out.collect() if r.doc_id in (1, 2)} == {(1, 0.0), (2, 0.0)}
    assert quality.fit(messy, labels.where("quality = 1")) is None and quality.fit(none, labels) is None
    assert quality.classify(none, net).count() == 0
    kept = quality.good_documents(clashing, None)
    assert kept.columns == clashing.columns and ids(kept) == [3, 4, 4, 5, 6, 7, 8, 9, None]
    assert quality.good_documents(none, net).count() == 0


def test_langid(messy, none, spark):
    out = langid.identify_documents(messy)
    assert ids(out) == ALL
    assert all(r.language == "und" and r.share == 0 and r.n_grams == 0 for r in out.collect() if r.doc_id in (1, 2, 3, 9))
    assert langid.identify_documents(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert langid.identify_documents(unlabelled).collect()[0].language == "und"


def test_simhash(messy, none, clashing):
    out = simhash.group_documents(messy)
    assert ids(out) == ALL
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, not r.keep))
    four = [r for r in rows if r.group_id == 4]
    assert [r.doc_id for r in four] == [4, 4, 5, None] and [r.keep for r in four] == [True, False, False, False] and {r.group_size for r in four} == {4}
    assert all(r.keep for r in rows if r.doc_id in (1, 2, 3, 6, 7, 8, 9))
    assert simhash.group_documents(none).count() == 0
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns and ids(kept) == [1, 2, 3, 4, 6, 7, 8, 9, None]
    assert simhash.one_of_each(none).count() == 0


def test_mixing(messy, none, clashing, spark):
    out = mixing.mix(messy)
    assert {r.source for r in out.collect()} <= {"", "a", "b"}
    assert mixing.mix(none).count() == 0
    same = mixing.mix_documents(clashing)
    assert same.columns == clashing.columns and ids(same) == ids(out)
    only = mixing.mix(messy, {"b": 1.0, "unheard of": 3.0}, total_tokens=10)
    assert all(r.source == "b" for r in only.collect())
    silent = spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id bigint, text string, source string")
    assert mixing.mix(silent).count() == 0
    once = spark.createDataFrame([(i, "a b c d", "s") for i in range(10)], "doc_id bigint, text string, source string")
    assert mixing.mix(once, total_tokens=20).count() == 5 and mixing.mix(once, total_tokens=103).count() == 25


def test_decontamination(messy, none, clashing, bench, spark):
    out = decontamination.decontaminate(messy, bench)
    assert ids(out) == ALL
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[4].action == "trim" and rows[4].n_removed >= 30 and rows[6].action == "keep" and rows[1].text is None and rows[2].text == ""
    same = decontamination.decontaminate(messy, bench, broadcast_grams=0)
    assert sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    short = spark.createDataFrame([(1, "a Tiny, ITEM here and some more words"), (2, "tiny  item!"), (3, "one of FIVE small, words")], "doc_id bigint, text string")
    items = bench.unionByName(spark.createDataFrame([(5, "of five small words"), (6, "one of five small words")], bench.schema))
    for limit in (0, 1000):
        got = {tuple(r)[:2] + (r.text,) for r in decontamination.decontaminate(short, items, broadcast_grams=limit).collect()}
        assert got == {(1, "keep", "a Tiny, ITEM here and some more words"), (2, "drop", None), (3, "drop", None)}
    common = spark.createDataFrame([(1, "Yes"), (2, "The")], "item_id bigint, text string")
    plain = spark.createDataFrame([(1, "the cat said yes to the other cat"), (2, "Yes.")], "doc_id bigint, text string")
    assert {(r.doc_id, r.action) for r in decontamination.decontaminate(plain, common).collect()} == {(1, "keep"), (2, "drop")}
    for limit in (0, 1000):
        kept = decontamination.decontaminate_documents(clashing, bench, broadcast_grams=limit)
        assert kept.columns == clashing.columns and ids(kept) == ALL
        assert all(r.n_chars == len(r.text) for r in kept.where("doc_id = 4").collect())
    assert decontamination.decontaminate(none, bench).count() == 0
    assert {r.action for r in decontamination.decontaminate(messy, bench.limit(0)).collect()} == {"keep"}


def test_shards(messy, none):
    shards = sstable.token_shards(messy, shard_bytes=1 << 12).orderBy("shard").collect()
    entries = [(i, ids.tolist()) for s in shards for i, ids in sstable.Shard(bytes(s.data), True)]
    assert sorted((i for i, _ in entries), key=lambda x: (x is None, x)) == ALL
    assert [i is not None for i, _ in entries] == sorted(i is not None for i, _ in entries)
    assert all(x == [] for i, x in entries if i in (1, 2))
    assert sum(len(s.data) for s in shards) == sum(s.n_bytes for s in shards)
    found = sstable.lookup(sstable.token_shards(messy), [4, 6, 12345]).collect()
    assert sorted(r.doc_id for r in found) == [4, 4, 6]
    assert sstable.token_shards(none).count() == 0


def test_revisits(spark):
    log = spark.createDataFrame(
        [
            (1, "http://www.a.com/x/", "response", 10, {"etag": '"1"', "server": "s"}, "one"),
            (1, "http://www.a.com/x/", "response", 10, {"etag": '"1"', "server": "s"}, "one"),
            (2, "https://a.com/x#top", "response", 20, {"etag": '"2"'}, "two"),
            (3, "HTTP://A.com/x?utm_source=q", "revisit", 20, {"etag": 'W/"1"', "server": "new", "date": "d"}, None),
            (4, "http://a.com/x", "revisit", 30, {"etag": '"1"'}, None),
            (5, "http://a.com/x", "revisit", 30, None, None),
            (6, "http://a.com/x", "revisit", 5, {}, None),
            (7, None, "revisit", 30, {"etag": '"1"'}, None),
            (8, "http://a.com/x", "revisit", None, {"etag": '"1"'}, None),
            (8, "http://a.com/x", "revisit", None, {"etag": '"1"'}, None),
            (9, "http://a.com/y", "other", 30, {}, None),
        ],
        "record_id bigint, url string, kind string, at bigint, headers map<string,string>, body string",
    )
    out = {(r.record_id, r.status, r.source_id, r.body) for r in revisits.resolve_revisits(log).collect()}
    assert out == {(3, "resolved", 1, "one"), (4, "etag-mismatch", None, None), (5, "no-validator", None, None), (6, "no-earlier-response", None, None), (7, "no-earlier-response", None, None), (8, "no-earlier-response", None, None)}
    (headers,) = [r.headers for r in revisits.resolve_revisits(log).where("record_id = 3").collect()]
    assert headers == {"etag": 'W/"1"', "server": "s", "date": "d"}
    assert revisits.resolve_revisits(log).count() == 7
    assert revisits.resolve_revisits(log.limit(0)).count() == 0
    pages = spark.createDataFrame([(None, None, None), (3, "", None), (3, "", None)], "page_id bigint, url string, html string")
    assert revisits.resolve_pages(pages).count() == 6


def test_line_dedup(messy, none, spark):
    out = linededup.drop_boilerplate(messy)
    assert ids(out) == ALL
    assert {(r.doc_id, r.text) for r in out.collect() if r.doc_id in (1, 2)} == {(1, None), (2, "")}
    assert linededup.drop_boilerplate(none).count() == 0
    site = spark.createDataFrame([(i, f"menu \nown {i}\n\nmenu", None) for i in range(6)] + [(9, "menu\nother", "elsewhere")], "doc_id bigint, text string, source string")
    texts = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_boilerplate(site).collect()}
    assert texts[0] == ("own 0\n", 4, 2) and texts[9] == ("menu\nother", 2, 0)
    # a line on exactly the ratio stays
    assert {r.n_dropped for r in linededup.drop_boilerplate(site, ratio=1.0).collect()} == {0}


def test_line_dedup_on_hosts_of_every_size(spark):
    # line k is on the first k pages of its host
    sizes = range(1, 51)
    rows = [(100 * n + i, "\n".join(f"line {k}" for k in range(1, n + 1) if i < k), f"host {n}") for n in sizes for i in range(n)]
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("doc_id % 100 = 0").collect()
    assert {r.doc_id // 100: r.n_dropped for r in out} == {n: sum(k >= 2 and 20 * k > n for k in range(1, n + 1)) for n in sizes}


def test_line_ends(spark):
    site = spark.createDataFrame([(i, f"menu{end}\nown {i}") for i, end in enumerate(["", "\r", " \t", "\r"])], "doc_id bigint, text string").selectExpr("*", "'s' AS source")
    assert {r.n_dropped for r in linededup.drop_boilerplate(site).collect()} == {1}


@pytest.mark.parametrize("kind", ["int", "string", "smallint"])
def test_ids_of_any_type(clashing, bench, spark, kind):
    """Every operator passes the identifier on with its own type, also beside columns of clashing names."""
    table = clashing.withColumn("doc_id", clashing.doc_id.cast(kind))
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id bigint, quality int").selectExpr(f"cast(doc_id as {kind}) AS doc_id", "quality")
    net = quality.fit(table, labels)
    results = [
        licenses.scan_documents(table), winnowing.winnow(table), winnowing.fingerprints(table), quality.classify(table, net), quality.good_documents(table, net),
        langid.identify_documents(table), simhash.group_documents(table), simhash.one_of_each(table), mixing.mix(table), mixing.mix_documents(table),
        decontamination.decontaminate(table, bench), decontamination.decontaminate(table, bench, broadcast_grams=0), decontamination.decontaminate_documents(table, bench), linededup.drop_boilerplate(table),
    ]
    assert net is not None
    for out in results:
        assert dict(out.dtypes)["doc_id"] == kind and out.count() > 0
    shards = sstable.token_shards(table, shard_bytes=1 << 12)
    entries = [i for s in shards.orderBy("shard").collect() for i, _ in sstable.Shard(bytes(s.data), True)]
    want = [str(i) if kind == "string" and i is not None else i for i in ALL]
    assert entries == sorted(want, key=lambda x: (x is not None, x if x is not None else want[0]))
    assert sstable.lookup(shards, [want[3], want[7]]).count() == 3


def test_revisit_headers(spark):
    schema = "record_id bigint, url string, kind string, at bigint, headers map<string,string>, body string, stored string, carried string, slot string"
    rows = [
        (1, "http://a.com/A", "response", 10, {"ETag": '"1"', "Server": "s", "Date": "old"}, "one", "", "", ""),
        (2, "http://a.com/a", "response", 20, {"ETag": '"2"'}, "x" * 300_000, "", "", ""),
        (3, "http://a.com/A", "revisit", 90_000, {"etag": '"1"', "DATE": "new", "server": "other"}, None, "", "", ""),
        (4, "http://a.com:80/a?", "revisit", 90_000, {"ETAG": 'W/"2"'}, None, "", "", ""),
    ]
    out = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert (out[3].status, out[3].source_id, out[3].body) == ("resolved", 1, "one") and out[3].headers == {"etag": '"1"', "server": "s", "date": "new"}
    assert (out[4].status, out[4].source_id, len(out[4].body)) == ("resolved", 2, 300_000)


def test_pipeline_on_messy_and_empty_tables(messy, none, spark, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, " ".join(WORDS.split()[40:70])), (2, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("messy", messy), ("empty", none)):
        folder = str(tmp_path / name)
        for table, rows in (("documents", docs), ("benchmark", bench), ("labels", labels)):
            rows.write.parquet(f"{folder}/{table}.parquet")
        out = corpus_pipeline.run(spark, folder)
        entries = [i for s in out.collect() for i, _ in sstable.Shard(bytes(s.data), True)]
        assert set(entries) <= set(ALL) and (entries == []) == (name == "empty")


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace as Stub

    from folioframe.llm.common import shared_dir

    def session(master, folder=None):
        return Stub(conf=Stub(get=lambda key, default: folder), sparkContext=Stub(master=master))

    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(session("local[4]")).endswith("folioframe-shared")
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
