"""Results against SQL, brute force, exact round trips and held-out accuracy."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, check_same
from folioframe.llm import decontamination, langid, licenses, quality, queries, revisits, simhash, sstable, tokens, winnowing
from folioframe.llm.common import words_of
from folioframe.llm.license_texts import TEMPLATES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    assert check_same(queries.queries()[name](spark, str(DATA)), duck, queries.oracle_sql()[name]) > 0


@given(st.text("ab cÉ.1", max_size=120), st.integers(1, 6), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_winnowing_by_definition(text, k, w):
    hashes, positions = winnowing.fingerprints_of(text, k, w)
    chars = [(i, c) for i, c in enumerate(text.lower()) if c.isalnum()]
    grams = [sum(ord(c) * pow(winnowing.BASE, j, 1 << 64) for j, (_, c) in enumerate(chars[i : i + k])) % (1 << 64) for i in range(len(chars) - k + 1)]
    chosen = {max((i for i in range(a, min(a + w, len(grams))) if grams[i] == min(grams[a : a + w])), default=0) for a in range(max(1, len(grams) - w + 1))} if grams else set()
    assert positions.tolist() == [chars[i][0] for i in sorted(chosen)] and hashes.tolist() == [grams[i] for i in sorted(chosen)]


@given(st.text("abcd", min_size=20, max_size=40), st.text("abcd", max_size=30), st.text("abcd", max_size=30))
@settings(max_examples=100, deadline=None)
def test_winnowing_guarantee(shared, before, after):
    k, w = 6, 15  # a shared passage of w + k - 1 = 20 characters
    a, b = (set(winnowing.fingerprints_of(t, k, w)[0].tolist()) for t in (before + shared, shared + after))
    assert a & b


def naive_licences(text, frequencies, n):
    """(licence, notice, first word, end, coverage) of every notice at every place of the text, without the index."""
    words = words_of(text)
    found = []
    for name, licence, notice, keys in TEMPLATES:
        mine = words_of(notice)
        idf = {w: np.log((n + 1) / (frequencies[w] + 1)) for w in mine}
        chosen = sorted(set(mine) & set(words), key=lambda w: (-idf[w], mine.index(w)))[: licenses.RARE]
        needed = max(1, int(np.ceil(licenses.AGREE * min(licenses.RARE, len(idf)))))
        votes = sorted((i - j, w) for w in chosen for i, x in enumerate(words) if x == w for j, y in enumerate(mine) if y == w)
        groups = []
        for start, w in votes:
            if groups and start - groups[-1][-1][0] <= licenses.SLACK:
                groups[-1].append((start, w))
            else:
                groups.append([(start, w)])
        for group in groups:
            said = words[max(0, group[0][0] - licenses.SLACK) : max(0, group[-1][0] + len(mine) + licenses.SLACK)]
            there = all(any(said[i : i + len(p)] == p for i in range(len(said))) for p in map(words_of, keys))
            if there and len({w for _, w in group}) >= needed:
                starts = [s for s, _ in group]
                best = max(sorted(set(starts)), key=starts.count)
                same = sum(0 <= best + i < len(words) and words[best + i] == w for i, w in enumerate(mine))
                found.append((licence, name, max(0, best), min(best + len(mine), len(words)), same / len(mine), same))
    kept = []
    for m in sorted(found, key=lambda m: (-m[5], m[2], [t[0] for t in TEMPLATES].index(m[1]))):
        if not any(k[0] == m[0] and k[2] < m[3] and m[2] < k[3] for k in kept):
            kept.append(m[:5])
    return sorted(kept, key=lambda m: (m[2], m[0]))


def test_licences_by_brute_force(spark, docs, duck):
    frequencies, n = licenses.document_frequencies(docs, licenses.vocabulary())
    assert n == docs.count() and frequencies["license"] == sum("license" in words_of(t) for (t,) in duck.execute("SELECT text FROM documents").fetchall())
    rng = random.Random(3)
    texts = [t for (t,) in duck.execute("SELECT text FROM documents WHERE length(text) < 3000 ORDER BY doc_id LIMIT 60").fetchall()]
    for name, _, text, _ in TEMPLATES:
        words = text.split()
        drop = rng.randrange(len(words))
        texts += [f"# {text}\n* code", " ".join(words[:drop] + words[drop + 1 :]), " ".join(words[: len(words) // 2]), " ".join(rng.sample(words, len(words)))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = licenses.build_index(frequencies, n)
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in licenses.scan(table, index).collect()}
    assert got == {i: naive_licences(t, frequencies, n) for i, t in enumerate(texts)}
    assert all(licence in {m[0] for m in got[60 + 4 * i]} for i, (_, licence, _, _) in enumerate(TEMPLATES))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    net = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = quality.classify(docs, net).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r.keep == (r.quality > 0) for r in held]) > 0.95
    assert np.mean([r.keep for r in held if r.quality > 0]) > 0.98


def test_quality_covers_the_whole_text():
    rng = np.random.default_rng(0)
    net = quality.Network.start(rng)
    net.bias += 0.05
    for n in (1, 7, 130, 1000):
        data = bytes(rng.integers(32, 126, n).tolist())
        padded = np.frombuffer(data + bytes(quality.WIDTH), np.uint8)
        at = np.arange(0, n, quality.STRIDE)
        y = np.maximum(np.stack([net.embed[padded[a : a + quality.WIDTH]].ravel() for a in at]) @ net.filters + net.bias, 0)
        halves = [y[i : i + quality.HALF].max(0) for i in range(0, len(at), quality.HALF)]
        chunks = [np.maximum(h, halves[i + 1]) if i + 1 < len(halves) else h for i, h in enumerate(halves)]
        x = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0), [1]])
        others = pa.array(["before", data.decode(), None, "after" * 100])
        assert quality.probabilities(net, others)[1] == pytest.approx(1 / (1 + np.exp(-x @ net.out)), rel=1e-4)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = langid.fit(docs.where("doc_id % 2 = 0"), 100)
    rows = langid.identify(docs.where("doc_id % 2 = 1"), filters).join(docs, "doc_id").where("n_chars > 100").collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.97
    # masks hold every member, and the correction takes false positives out again
    for bit, language in enumerate(filters.languages):
        assert ((filters.masks(filters.grams[language])[0] >> bit) & 1).all()
    strange = np.random.default_rng(1).integers(1 << 50, 1 << 55, 200_000).astype(np.uint64)
    rates = np.array([((filters.masks(strange)[0] >> b) & 1).mean() for b in range(len(filters.languages))])
    assert np.abs(rates - filters.false_rates).max() < 5e-4


def naive_fold(text):
    """A space, then the text's letters in lower case with a space for each run of others."""
    return re.sub(rb"[^a-z'\x80-\xff]+", b" ", b" " + text.lower().encode())


def naive_grams(data):
    """The n-grams of folded text by size."""
    return {size: [data[i : i + size] for i in range(len(data) - size + 1)] for size in langid.SIZES}


@pytest.mark.parametrize("languages", [4, 70])
def test_language_counts_by_brute_force(spark, docs, languages):
    """Counts, shares and choice of whole rows against plain sets of n-grams."""
    rows = docs.select("doc_id", "text", "lang").where("n_chars < 4000").limit(150).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.lang if languages == 4 else f"l{r.doc_id % languages:02}", []).append(r.text)
    filters = langid.build_filters({k: sorted(v) for k, v in texts.items()})
    assert len(filters.tables) == (len(texts) + 63) // 64
    members = {}
    for language, some in texts.items():
        for size in langid.SIZES:
            grams = naive_grams(b"".join(map(naive_fold, sorted(some))) + b" ")[size]
            counts = Counter(grams)
            least = max(2.0, langid.MIN_RATE * len(grams) / 1e6)
            members[language] = members.get(language, set()) | {g for g, n in counts.items() if n >= least}
    got = {r.doc_id: r for r in langid.identify(docs.where("n_chars < 4000").limit(150), filters).collect()}
    for r in rows[:40]:
        grams = [g for by in naive_grams(naive_fold(r.text)).values() for g in by]
        shares = {}
        for language in filters.languages:
            code = np.array([int.from_bytes(g, "big") | len(g) << 56 for g in grams], np.uint64)
            at = filters.languages.index(language)
            bits = (filters.masks(code)[at // 64] >> np.asarray(at % 64, filters.tables[at // 64].dtype)) & 1
            assert all(bit for bit, g in zip(bits, grams) if g in members[language])
            rate = filters.false_rates[at]
            shares[language] = min(1, max(0, (int(bits.sum()) - len(grams) * rate) / (len(grams) * (1 - rate))))
            true = sum(g in members[language] for g in grams)
            assert abs(int(bits.sum()) - true) <= 5 + 3 * len(grams) * rate
        best = max(shares, key=lambda x: (shares[x], [-ord(c) for c in x]))
        assert got[r.doc_id].n_grams == len(grams) and got[r.doc_id].share == pytest.approx(shares[best])
        assert got[r.doc_id].language == (best if shares[best] >= langid.MIN_SHARE else "und")


def test_language_sample_is_bounded(spark):
    """Repeats count once, and the bound holds exactly."""
    rows = [(i, f"text {i % 3}" if i < 3000 else f"other text {i}", "xx") for i in range(4000)] + [(5000, "one", "yy"), (5001, "one", "yy")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [r.text for r in langid.sample(table, 600).where("lang = 'xx'").collect()]
    assert len(got) == len(set(got)) == 600
    assert langid.sample(table, 600).where("lang = 'yy'").count() == 1


def test_revisits_by_brute_force(spark):
    """The as-of join over hot URLs with many slots, against a loop over all earlier responses."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        kind = rng.choice(["response", "revisit"])
        tag = f'"{rng.randrange(3)}"'
        rows.append((i, f"http://{rng.choice(['a.com', 'b.org'])}/{rng.choice('xY')}", kind, rng.randrange(0, 60_000, 50), {"ETag": tag, "Server": str(i)}, f"body {i}" if kind == "response" else None))
    log = spark.createDataFrame(rows, "record_id bigint, url string, kind string, at bigint, headers map<string,string>, body string")
    want = {}
    for i, url, kind, at, headers, _ in rows:
        if kind == "revisit":
            earlier = [r for r in rows if r[2] == "response" and r[1] == url and r[3] < at]
            last = max(earlier, key=lambda r: (r[3], r[0]), default=None)
            same = last and last[4]["ETag"] == headers["ETag"]
            want[i] = ("no-earlier-response" if last is None else "resolved" if same else "etag-mismatch", last[0] if same else None, last[5] if same else None)
    got = {r.record_id: (r.status, r.source_id, r.body) for r in revisits.resolve_revisits(log).collect()}
    assert got == want and {s for s, _, _ in want.values()} == {"resolved", "etag-mismatch", "no-earlier-response"}


def test_canonical_urls(spark, duck):
    same = [
        ["http://a.com/X", "https://A.com:443/X", "HTTP://www.a.COM:80/X/", "http://a.com/X#top", "http://a.com/X?utm_source=q", " http://a.com/X? "],
        ["http://a.com/x"], ["http://m.a.com/X"], ["http://a.com:8080/X"], ["http://a.com", "http://a.com/", "a.com"],
        ["http://a.com/X?b=2&a=1", "http://a.com/X?a=1&utm_medium=x&b=2", "http://a.com/X/?a=1&&b=2"], ["http://a.com/X?ref=1"], ["http://a.com/X?A=1&b=2"],
    ]
    rows = [(i, url) for i, urls in enumerate(same) for url in urls]
    table = spark.createDataFrame(rows, "i int, url string")
    got = {}
    for r in table.select("i", "url", revisits.canonical_url(table.url).alias("c")).collect():
        got.setdefault(r.c, set()).add(r.i)
        assert duck.execute(f"SELECT {revisits.canonical_sql('u')} FROM (SELECT ? AS u)", [r.url]).fetchone()[0] == r.c
    assert sorted(map(sorted, got.values())) == [[i] for i in range(len(same))]


def test_shards_as_files(spark, docs, tmp_path):
    """A lookup reads footer, filter, index and one block, and no more."""
    shards = sstable.token_shards(docs, shard_bytes=1 << 18)
    files = sstable.write_shards(shards, str(tmp_path / "out"))
    rows = files.collect()
    assert len(rows) > 1 and sum(r.n_entries for r in rows) == docs.count()
    encoding = tokens.encoding(tokens.default_vocabulary())
    texts = {r.doc_id: r.text for r in docs.where("n_chars < 2000").limit(5).collect()}
    found = sstable.lookup(files, list(texts) + [10**9]).collect()
    assert {r.doc_id: encoding.decode(r.ids) for r in found} == texts
    row = max(rows, key=lambda r: r.n_bytes)
    shard = sstable.ShardFile(row.path)
    opened = shard.bytes_read
    assert opened < row.n_bytes / 10
    shard.get(row.last_id)
    assert shard.bytes_read - opened == shard.offsets[-1] - shard.offsets[-2]
    before = shard.bytes_read
    assert shard.get(10**9) == [] and shard.bytes_read == before


def test_wide_token_ids(spark, tmp_path):
    import base64

    path = tmp_path / "wide.tiktoken"
    lines = [(bytes([i]), i) for i in range(256)] + [(b"ab", 70_000), (b" ab", 70_001), (b" a", 300)]
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for t, i in lines))
    table = spark.createDataFrame([(1, "ab ab x"), (2, "")], "doc_id int, text string")
    (row,) = sstable.token_shards(table, str(path)).collect()
    assert [(i, ids.tolist()) for i, ids in sstable.Shard(bytes(row.data))] == [(1, [70_000, 70_001, 32, 120]), (2, [])]
    assert row.n_tokens == 4


def naive_simhash(text):
    """SimHash and features of a text, by the definition and with a feature at a time."""
    data, offsets = simhash.lowered(pa.array([text]))
    starts, ends, _ = simhash.word_spans(data, offsets)
    words = simhash.word_hashes(data, starts, ends).tolist()
    pairs = [int(x) for x in simhash.splitmix(np.array([(a * simhash.BASE + b) % (1 << 64) for a, b in zip(words, words[1:])], np.uint64))]
    features = {x % (1 << 48) for x in words + pairs}
    votes = np.zeros(simhash.BITS, np.int64)
    for x in features:
        a = simhash.splitmix(np.array([x], np.uint64))
        votes += np.unpackbits(np.r_[a, simhash.splitmix(a)].view(np.uint8))
    return np.packbits(votes * 2 > len(features)).view(np.uint64), features


def connected(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def copied(spark, docs):
    """The documents and changed copies of some, with all pairs within the radius that share enough features."""
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(5)
    extra = []
    for doc_id, text in rows[:60]:
        words = text.split(" ")
        for _ in range(max(1, len(words) // 50)):
            words[rng.randrange(len(words))] = "changed"
        extra.append((10_000 + doc_id, " ".join(words)))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    everything = rows + extra
    known = [naive_simhash(t) for _, t in everything]
    sims = np.stack([s for s, _ in known])
    near = np.bitwise_count(sims[:, None] ^ sims[None]).sum(2) <= simhash.RADIUS
    share = lambda x, y: len(x & y) / max(1, len(x | y))
    pairs = [(i, j, share(known[i][1], known[j][1])) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    return table, everything, pairs


def test_forest_by_brute_force(copied):
    """Over all pairs, with SimHashes and shares of features worked out plainly; the estimate may err by 0.2."""
    table, everything, pairs = copied
    group = {r.doc_id: r.group_id for r in simhash.group_documents(table).collect()}
    near = [(i, j) for i, j, share in pairs if share >= simhash.LEAST_SHARED + 0.2]
    assert len(near) > 50 and np.mean([group[everything[i][0]] == group[everything[j][0]] for i, j in near]) >= 0.9
    texts = {}
    alike = [(i, j) for i, j, share in pairs if share >= simhash.LEAST_SHARED - 0.2]
    alike += [(texts.setdefault(t, i), i) for i, (_, t) in enumerate(everything)]
    root = connected(len(everything), alike)
    at = {d: root[i] for i, (d, _) in enumerate(everything)}
    assert all(at[d] == at[g] for d, g in group.items())
    assert all(g == min(d for d in group if group[d] == g) for g in set(group.values()))


def test_forest_with_small_windows(copied, spark):
    """The same with windows far smaller than the table, so that prefixes, parts and chunks matter."""
    table, everything, pairs = copied
    nodes = simhash._slim(table).dropDuplicates(["key"]).where("n_features > 0")
    window = 4
    assert simhash.shape(nodes.count(), window=window)[0] > simhash.PART
    met = {frozenset((bytes(r.a), bytes(r.b))) for r in simhash.near_edges(nodes, nodes.count(), window=window).collect()}
    key = {r.doc_id: bytes(r.key) for r in simhash._slim(table).collect()}
    ids = sorted(set(key.values()))
    at = {k: i for i, k in enumerate(ids)}
    root = connected(len(ids), [tuple(sorted(at[k] for k in pair)) for pair in met])
    near = [(key[everything[i][0]], key[everything[j][0]]) for i, j, share in pairs if share >= simhash.LEAST_SHARED + 0.2]
    assert np.mean([root[at[a]] == root[at[b]] for a, b in near]) >= 0.9


@pytest.mark.parametrize("n", [2, 40, 700])
def test_linked_components(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 1 << 63, (5, 2), dtype=np.uint64)
    sims = centre[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 63, (n, 2)).astype(np.uint64))
    part = np.arange(n) // 400
    i, j = simhash.linked(sims[:, 0].copy(), sims[:, 1].copy(), part, radius=8)
    assert (np.bitwise_count(sims[i] ^ sims[j]).sum(1) <= 8).all() and (part[i] == part[j]).all()
    near = (np.bitwise_count(sims[:, None] ^ sims[None]).sum(2) <= 8) & (part[:, None] == part)
    root = connected(n, zip(i.tolist(), j.tolist()))
    assert root == connected(n, zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


@pytest.fixture(scope="module")
def dense(spark):
    """Nodes that are all near each other, of which only i and i + 100 share features."""
    rng, n = np.random.default_rng(3), 200
    bits = np.zeros((n, simhash.BITS), np.uint8)
    for row in bits:
        row[rng.choice(simhash.BITS, 11, replace=False)] = 1
    sims = np.packbits(bits, axis=1).view(np.int64)
    sketches = [np.arange(i % 100 * 64, i % 100 * 64 + 64, dtype=np.uint32).tobytes() for i in range(n)]
    rows = [(i.to_bytes(4, "big"), i, int(sims[i, 0]), int(sims[i, 1]), sketches[i]) for i in range(n)]
    return sims.view(np.uint64), spark.createDataFrame(rows, "key binary, id bigint, hi bigint, lo bigint, sketch binary")


def test_forest_compares_whole_buckets(dense):
    """Partners that stand farther apart than the window, between texts that are near but share nothing, are linked."""
    sims, nodes = dense
    root = connected(len(sims), [tuple(sorted(int.from_bytes(bytes(k), "big") for k in r)) for r in simhash.near_edges(nodes, 1, window=4).collect()])
    assert root == [i % 100 for i in range(len(sims))]


@pytest.mark.parametrize("big", [1000, 150, 30])
def test_bucket_pairs_by_brute_force(dense, big):
    """Each pair of different classes that shares a bucket once, in one piece or in blocks."""
    sims, nodes = dense
    of = np.arange(len(sims)) // 3
    order, depth = simhash.orders(5), 3
    bits = np.unpackbits(sims.view(np.uint8), axis=1)
    met = np.zeros((len(sims),) * 2, bool)
    for trie in order:
        met |= (bits[:, None, trie[:depth]] == bits[None, :, trie[:depth]]).all(2)
    near = np.bitwise_count(sims[:, None] ^ sims[None]).sum(2) <= 21
    wanted = sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(met & near & (of[:, None] != of), 1)))))
    classed = nodes.selectExpr("*", "id div 3 as class")
    assert sorted(map(tuple, simhash.bucket_pairs(classed, depth, order, radius=21, big=big).collect())) == wanted and len(wanted) > 1000


def test_forest_recall_at_the_radius():
    tries = []
    for n in (10, 10_000, 10**6, 10**7, 10**10, 10**12):
        depth, many = simhash.shape(n)
        tries.append(many)
        assert 1 - (1 - simhash.meet(simhash.RADIUS, depth)) ** many >= simhash.RECALL
        assert n <= simhash.WINDOW << depth
    assert tries == sorted(tries) and tries[0] == 1


@given(st.lists(st.tuples(*[st.sets(st.integers(0, 200), max_size=90)] * 2), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_shared_features(pairs):
    def sketch(features):
        return np.array(sorted(features)[: simhash.SKETCH], np.uint32).tobytes()

    got = simhash.shared_features(*(pa.array([sketch(p[k]) for p in pairs], pa.binary()) for k in (0, 1)))
    for share, (a, b) in zip(got, pairs):
        least = sorted(set(sorted(a)[: simhash.SKETCH]) | set(sorted(b)[: simhash.SKETCH]))[: simhash.SKETCH]
        assert share == sum(x in a and x in b for x in least) / max(1, len(least))


@given(st.lists(st.text(max_size=30) | st.text(" '\nastmrevld12.é\t", max_size=40) | st.none(), max_size=12))
@settings(max_examples=200, deadline=None)
def test_token_ids(texts):
    encoder = tokens.Encoder(tokens.default_vocabulary())
    ids, counts = encoder(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encoder.encoding.encode_ordinary(t or "") for t in texts] if texts else not len(ids)
    plain = encoder.plainly(pa.array(texts, pa.string()))
    assert plain[0].tolist() == ids.tolist() and plain[1].tolist() == counts.tolist()


def test_shard_round_trip(spark, docs, duck):
    shards = sstable.token_shards(docs, shard_bytes=1 << 16).orderBy("shard").collect()
    encoding = tokens.encoding(tokens.default_vocabulary())
    want = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = [(i, encoding.decode(ids.tolist())) for s in shards for i, ids in sstable.Shard(bytes(s.data), True)]
    assert len(shards) > 3 and got == sorted(want.items())
    for s in shards:
        reader = sstable.Shard(bytes(s.data))
        assert all(len(reader.get(i)) == 1 for i in (s.first_id, s.last_id)) and reader.get(10**9) == []
    damaged = bytearray(shards[0].data)
    damaged[5] ^= 1
    with pytest.raises(ValueError):
        sstable.Shard(bytes(damaged), True)


@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1) | st.none(), st.binary(max_size=9).map(lambda b: b * 2)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_shards_of_any_keys(entries):
    entries.sort(key=lambda e: (sstable.key_of(e[0]), e[1]))
    shard = sstable.Shard(sstable.build([(sstable.key_of(i), v) for i, v in entries], block_bytes=32), True)
    assert [(i, ids.tobytes()) for i, ids in shard] == entries
    for i in {i for i, _ in entries}:
        assert [x.tobytes() for x in shard.get(i)] == [v for j, v in entries if j == i]


def test_pipeline_stages(spark, duck):
    """Each stage against a plain form of it, on what the stage before it kept."""
    folder = str(DATA)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept, before = docs, None
    results = []
    for _, stage in corpus_pipeline.STAGES:
        before, kept = kept, corpus_pipeline.materialise(stage(spark, kept, folder))
        results.append((before, kept))
    assert all(k.columns == columns for _, k in results[:-1])
    rows = [sorted(map(tuple, b.collect())) for b, _ in results] + [results[-1][1].collect()]
    net = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    p = quality.probabilities(net, pa.array([r[1] for r in rows[0]]))
    assert rows[1] == [r for r, x in zip(rows[0], p) if x >= quality.THRESHOLD] and 0 < len(rows[1]) < len(rows[0])
    group = {r.doc_id: r.group_id for r in simhash.group_documents(results[1][0]).collect()}
    assert rows[2] == [r for r in rows[1] if group[r[0]] == r[0]] and len(rows[2]) < len(rows[1])
    grams = decontamination.GramSet([t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()], decontamination.N)
    flat = {g.decode() for g in grams.grams(decontamination.N)}
    has = lambda text: any(" ".join(w[i : i + 8]) in flat for w in [words_of(text)] for i in range(len(w) - 7))
    clean = {r[0]: r for r in rows[3]}
    assert all(clean[r[0]] == r for r in rows[2] if not has(r[1])) and not any(has(r[1]) for r in rows[3])
    total = {}
    for r in rows[4]:
        total[r[3]] = total.get(r[3], 0) + len(r[1].split())
    budget = sum(len(r[1].split()) for r in rows[3]) // len({r[3] for r in rows[3]})
    assert set(rows[4]) <= set(rows[3]) and all(t <= budget for t in total.values())
    entries = sorted(i for s in rows[5] for i, _ in sstable.Shard(bytes(s.data)))
    assert entries == sorted(r[0] for r in rows[4])


@pytest.mark.parametrize("stage", [0, 1, 2, 4])
def test_stages_bound_batches(spark, docs, stage):
    """After a stage planned its work, no batch of texts is larger than the limit by more than a row; a limit that is set stays."""
    name, size = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 12
    wide = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), size // 5).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    spark.conf.unset(name)
    try:
        corpus_pipeline.STAGES[stage][1](spark, docs.limit(20), str(DATA))
        assert max(r.n for r in wide.mapInArrow(sizes, "n bigint").collect()) <= (2 << 20) + 2 * size
        spark.conf.set(name, "1m")
        corpus_pipeline.STAGES[stage][1](spark, docs.limit(20), str(DATA))
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
