"""The training-data operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import bisect
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparklore.llm import exact, mixture, packing, pii, quality, queries, shards, simhash, suffixes, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _fp string, size string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def corpus():
    rnd = random.Random(3)
    words = ["w%d" % k for k in range(60)] + ["é", "ñandú", "The", "x,y", " "]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 30, 200]))) for _ in range(60)]
    passage = " ".join(rnd.choice(words) for _ in range(90))
    texts += [texts[5], texts[5].upper(), None, "", passage + " tail one", "head two " + passage, passage, "aaaa" * 120, "a", " \t\n", "é" * 150]
    rows = [(k, t, "en", ["s1", "s2", "s3", None][k % 4], 0, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[7], rows[70], (None, texts[9], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bytes(text):
    return (text or "").encode()


def fingerprint(text, k=3):
    words = WORD.findall(as_bytes(text).lower())
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints, radius):
    values = sorted(set(prints))
    owner = {v: v for v in values}

    def root(v):
        while owner[v] != v:
            v = owner[v]
        return v

    for i, v in enumerate(values):
        for w in values[i + 1 :]:
            if (v ^ w).bit_count() <= radius and root(v) != root(w):
                owner[root(v)] = root(w)
    return {v: root(v) for v in values}


def test_simhash(docs, rows):
    prints = [fingerprint(r[1]) for r in rows]
    roots = classes(prints, 2)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[roots[p]] = min(r[0], least.get(roots[p], r[0]))
    want = sorted(((r[0], f"{p:016x}", least.get(roots[p])) for r, p in zip(rows, prints, strict=True)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("radius", [2, 3, 5])
def test_links_of_dense_and_split_buckets(spark, radius):
    rnd = random.Random(radius)
    values = {rnd.getrandbits(64) for _ in range(300)}
    centre = rnd.getrandbits(64)
    for _ in range(200):
        v = centre
        for _ in range(rnd.randrange(4)):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    prints = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fp long")
    edges = simhash.links(prints, radius, bucket=20)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    unsigned = lambda x: x & (2**64 - 1)
    got, want = {}, {}
    for v in values:
        signed = int(np.array(v, np.uint64).view(np.int64))
        got.setdefault(unsigned(found.get(signed, signed)), set()).add(v)
    for v, r in classes(values, radius).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def five_words(text):
    """The set of five-word shingles; of fewer words, the whole sequence."""
    tokens = as_bytes(text).lower().split()
    return {b" ".join(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def similar_groups(texts, similarity=0.8):
    """Smallest index of each text's group by comparing all with all; links are Jaccard similarities of five-word shingle sets."""
    sets = [five_words(t) for t in texts]
    owner = list(range(len(texts)))

    def root(k):
        while owner[k] != k:
            k = owner[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if (x == sets[j] or len(x & sets[j]) >= similarity * len(x | sets[j])) and root(i) != root(j):
                owner[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(texts))]


def near_texts(rnd, n, changes, length=300):
    """``n`` copies of one text with a number of words changed from ``changes``."""
    base = ["v%d" % rnd.randrange(5000) for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rnd.sample(range(length), rnd.choice(changes)):
            copy[at] = "x%d" % rnd.randrange(10**6)
        out.append(" ".join(copy))
    return out


def stays(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(df, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_SIMILARITY).collect())


def test_near_copies_go_as_all_pairs_say(spark):
    """Copies on both sides of 0.8, appended and cut texts, short texts, a shared passage: the same groups as all pairs give."""
    rnd = random.Random(9)
    texts = [t for _ in range(25) for t in near_texts(rnd, 5, (0, 3, 6, 7, 8, 9, 12, 30))]
    passage = " ".join("p%d" % k for k in range(120))
    for length in (8, 12, 20, 33, 50, 90, 200, 800):
        for _ in range(6):
            text = ["u%d" % rnd.randrange(9000) for _ in range(length)]
            texts += [" ".join(text), " ".join(text[: -max(1, length // 12)]), " ".join(text + ["end"] * max(1, length // 15)), " ".join(text + [passage])]
    rnd.shuffle(texts)
    want = similar_groups(texts)
    gone, go = set(range(len(texts))) - set(stays(spark, texts)), {k for k, r in enumerate(want) if r != k}
    assert len(gone & go) >= 0.98 * len(go) > 100
    kept_of = lambda k: {j for j in range(len(texts)) if want[j] == want[k]}
    assert all(len(kept_of(k)) > 1 for k in gone)  # none goes without a chain of links of 0.8 or more


def test_equal_fingerprints_do_not_link_different_texts(spark):
    """A phrase repeated 400 times gives both texts one SimHash; their sets of shingles share 4 in 100."""
    phrase = "one two three " * 400
    texts = [phrase + " ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    assert simhash.fingerprint(texts[0].encode(), 5) == simhash.fingerprint(texts[1].encode(), 5)
    assert stays(spark, texts) == [0, 1]


def test_no_link_of_a_large_group_is_lost(spark):
    """Near copies of one text, most pairs of them below 0.8, compared in small blocks: the groups of all pairs."""
    rnd = random.Random(21)
    texts = near_texts(rnd, 220, range(2, 9))
    want = similar_groups(texts)
    assert stays(spark, texts) == sorted(set(want))
    sets = [np.unique(simhash.shingle_hashes(as_bytes(t), 5)) for t in texts]
    shared = spark.createDataFrame([(b, k) for k in range(len(texts)) for b in (0, 1 + k % 3)], "bucket long, class long")
    shingles = spark.createDataFrame([(k, x.view(np.int64).tolist()) for k, x in enumerate(sets)], "class long, shingles array<long>")
    for block in (30, 1000):
        roots = {r.node: r.root for r in simhash.similar_classes(shared, lambda units: units.join(shingles, "class"), 0.8, block).collect()}
        assert [roots.get(k, k) for k in range(len(texts))] == want


def test_one_of_equal_and_empty_rows_stays(spark):
    """Nulls, empty and repeated rows: equal sets of shingles are one class, and texts without words are another."""
    text = "a b c d e f g h i j k l"
    rows = [(1, text, "x"), (1, text, "x"), (2, text.upper(), "y"), (None, text, "z"), (3, None, "n"), (4, "", "e"), (5, " \n", "s"), (None, None, "q")]
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert sorted((r.doc_id, r.fp) for r in left.collect()) == [(1, "x"), (3, "n")]


def test_parts_of_equal_shingles_have_equal_prints():
    rnd = np.random.default_rng(3)
    missed = 0
    for n in [int(x) for x in rnd.integers(8, 3000, 300)]:
        whole = rnd.integers(0, 2**63, n + n // 8, dtype=np.uint64)
        shift = n // 9  # two windows of n that share eight ninths: Jaccard 0.8
        a, b = np.unique(whole[:n]), np.unique(whole[shift : shift + n])
        missed += not np.intersect1d(simhash.part_prints(a, 0.8), simhash.part_prints(b, 0.8)).size
        assert len(simhash.part_prints(a, 0.8)) <= 2 * simhash.PARTS
    assert missed <= 6


def test_thresholds_follow_the_pigeonhole():
    rnd = np.random.default_rng(1)
    bits = rnd.random((500, 64)) < np.linspace(0.1, 0.9, 64)
    plan = simhash.choose_plan(10**6, bits.mean(axis=0), np.corrcoef(bits.T), 3)
    assert len({b for group, _ in plan for b in group}) == sum(len(g) for g, _ in plan)
    assert any(t >= 0 for _, t in plan)


def test_warc_round_trip(spark, tmp_path):
    body = "é" * 80
    pages = [(3, "http://a/\r\nx%", body), (1, "http://b/", body), (1, "http://c/", body), (2, None, "small"), (4, "u", "small"), (5, "v", None), (None, "w", body), (6, "q", "z" * 300000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(spark, df, str(tmp_path / "w")).collect()), key=str)
    want = []
    for page_id, _, html in pages:
        data = as_bytes(html)
        again = html == body and page_id != 1
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    urls_read = {r.target_uri for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert "http://a/\r\nx%" in urls_read
    assert warc.archived_pages(spark, df.limit(0), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("spoil", [lambda d: d[:-3], lambda d: b"junk" + d[4:], lambda d: d[:-40] + b"\0" + d[-39:]])
def test_warc_rejects_damage(spoil):
    record = warc.build_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    data = warc.build_archive([record] * 3)
    assert [r["payload"] for r in warc.read_archive(data)] == [b"payload"] * 3
    with pytest.raises(Exception):  # noqa: B017
        list(warc.read_archive(spoil(data)))
    with pytest.raises(warc.BadArchive):
        warc.parse_record(record.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"))


def test_shards(docs, rows):
    got = shards.shard_documents(docs).collect()
    assert len(got) == len(rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 for r in got)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(as_bytes(r[1])) + 8, zlib.crc32(as_bytes(r[1]))) for r in rows)


def test_placement_equals_draws_by_hand(spark):
    """Three weighted draws computed outside Spark, for regular and uneven trees."""

    def mark(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v[0].to_bytes(v[1], "little", signed=True), h)
        return h

    def least(doc, level, parents, weights):
        draws = []
        for k, w in enumerate(weights):
            h = mark((doc or 0, 8), (int(doc is None), 4), level, *[(p, 4) for p in parents], (k, 4))
            draws.append((-np.log(((h >> 12) + 0.5) / 2.0**52) / w, k))
        return min(draws)[1]

    for tree in (shards.HashTree.regular(24), shards.HashTree.regular(25), shards.HashTree((((1.0, 3.0), (2.0,)), ((4.0,), (1.0, 1.0, 1.0))))):
        starts = [0]
        for rack in (r for region in tree.weights for r in region):
            starts.append(starts[-1] + len(rack))
        ids = [*range(-5, 300), None, 2**62]
        rows = spark.createDataFrame([(k,) for k in ids], "doc_id long").select("doc_id", shards.place(F.col("doc_id"), tree).alias("shard")).collect()
        for r in rows:
            region = least(r.doc_id, b"region", [], [sum(map(sum, x)) for x in tree.weights])
            rack = least(r.doc_id, b"rack", [region], [sum(x) for x in tree.weights[region]])
            shard = least(r.doc_id, b"shard", [region, rack], tree.weights[region][rack])
            assert r.shard == starts[sum(map(len, tree.weights[:region])) + rack] + shard


def test_weights_move_rows_only_into_what_grew(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    before = shards.HashTree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0),)))
    after = shards.HashTree((((1.0, 1.0), (1.0, 2.0)), ((1.0, 1.0),)))
    rows = ids.select(shards.place(F.col("doc_id"), before).alias("a"), shards.place(F.col("doc_id"), after).alias("b")).collect()
    assert all(r.b in (0, 1, 2, 3) for r in rows if r.a != r.b) and any(r.a != r.b for r in rows)
    assert all(r.b == r.a or r.a in (4, 5) or r.b in (2, 3) for r in rows)
    for trees in ((24, 25), (25, 26), (26, 27)):
        moved = ids.select(shards.place(F.col("doc_id"), shards.HashTree.regular(trees[0])).alias("a"), shards.place(F.col("doc_id"), shards.HashTree.regular(trees[1])).alias("b")).filter("a <> b").collect()
        assert moved and all(r.b == trees[0] for r in moved)


def test_quality(docs, rows):
    def measure(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = {w: windows.count(w) for w in windows}
        covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_report(docs).collect()), key=str)
    assert got == sorted(((r[0], *measure(r[1])) for r in rows), key=str)


def test_strict_rules_hold_in_bad_hosts_only(spark):
    good, bad = "plain words " * 3 + " ".join(f"t{k}" for k in range(30)), " ".join(f"#{k}" for k in range(30))
    rows = [(k, bad, "spam") for k in range(30)] + [(40, good, "spam"), (41, bad, "fine")] + [(50 + k, good, "fine") for k in range(40)]
    kept = {r.doc_id for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").collect()}
    assert kept == {40, 41, *range(50, 90)}


@pytest.mark.parametrize("pairwise", [suffixes.PAIRWISE, 1])
def test_suffixes(docs, rows, pairwise, monkeypatch):
    monkeypatch.setattr(suffixes, "PAIRWISE", pairwise)
    texts = [as_bytes(r[1]) for r in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    want = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        want.append((r[0], len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_loser_tree_merges_and_keeps_prefixes():
    rnd = random.Random(5)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(30))) for _ in range(7)]
    order, prefixes = suffixes.merge_runs([(r, suffixes.common_prefixes(r).tolist()) for r in runs])
    merged = [runs[a][k] for a, k in order]
    assert merged == sorted(x for r in runs for x in r)
    assert prefixes == suffixes.common_prefixes(merged).tolist()
    shared, rest = suffixes.front_code(merged)
    assert suffixes.front_decode(shared.tolist(), [len(x) for x in merged], rest) == merged


def test_mixture(docs, rows):
    got = mixture.mixed(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(WORD.findall(as_bytes(r[1])))) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - sum(r.size for r in got)) <= 40
    one = sorted((str(r.row_key), r.size, r.taken) for r in got)
    assert one == sorted((str(r.row_key), r.size, r.taken) for r in mixture.mixed(docs.repartition(5)).collect())


def test_sainte_lague_equals_one_seat_at_a_time():
    rnd = random.Random(2)
    for _ in range(20):
        values = [rnd.random() * 10 ** rnd.randrange(3) for _ in range(7)]
        seats = [0] * 7
        for _ in range(53):
            best = max(range(7), key=lambda k: (values[k] / (2 * seats[k] + 1), -k))
            seats[best] += 1
        assert mixture.sainte_lague(np.array(values), 53).tolist() == seats
    assert mixture.sainte_lague(np.array([0.0, 0.0]), 5).tolist() == [0, 0]


def test_pii(spark):
    texts = ["Mail bo.x1@mail2.example.com, call +1 (830) 555-5433 or 193.195.198.107; card 4316522678525456, Mr. Adam Smith met Frau Müller.", "bo.x1@mail2.example.com again and Mr. Adam Smith", None, "clean text 12 and 3.14", 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" 4539 1488 0343 6467']
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[1]), (1, texts[1])]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and by[2].text is None and by[3].text == texts[3]
    for secret in ("bo.x1", "830", "193.195", "4316522678525456", "Adam Smith", "Müller", "2321bac4", "4539 1488"):
        assert not any(secret in (r.text or "") for r in got), secret
    mail = re.search(r"\S+@\S+com", by[0].text).group()
    name = re.search(r"Mr\. \w+ \w+", by[0].text).group()
    assert mail in by[1].text and name in by[1].text and name.split()[1] in pii.GIVEN["m"]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", by[4].text).group().replace(" ", "")
    digits = [int(x) for x in card[::-1]]
    assert sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2]) and (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0


def test_mentions_of_one_entity_read_alike(spark):
    texts = ["Mr. Adam Smith wrote to JO@x.com, then Mr Smith called +1 (830) 555-5433.", "Smith? Mr. Smith of jo@x.com is at +18305555433, or 830-555-5433.", "Dr. Anna Berg met John Miller and Sra. Lopez at 12 Baker Street and Hauptstraße 5.", "Mrs. Anna Smith, 4111 1111 1111 1111 and 4111111111111111.", "", None]
    df = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_entities int, _row string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert set(got[0].asDict()) == {"doc_id", "text", "n_entities_input", "_row", "n_entities", "entity_kinds"} and got[5].text is None and got[4].text == ""
    spots = ((0, r"Mr\. \w+ (\w+) wrote"), (0, r"Mr (\w+) called"), (1, r"Mr\. (\w+) of"), (3, r"Mrs\. \w+ (\w+),"))
    names = {re.search(pattern, got[k].text).group(1) for k, pattern in spots}
    assert len(names) == 1 and names != {"Smith"}
    mails = [re.search(r"\S+@\S+com", got[k].text).group() for k in (0, 1)]
    assert mails[0].lower() == mails[1] and mails[0] != mails[1] and mails[1] != "jo@x.com"
    phones = [re.sub(r"\D", "", x)[-10:] for k in (0, 1) for x in re.findall(r"\+1[ (\d)-]{9,}\d|\d{3}-\d{3}-\d{4}", got[k].text)]
    assert len(phones) == 3 and len(set(phones)) == 1 and phones[0] != "8305555433" and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0].text)
    assert not any(x in got[2].text for x in ("Berg", "Miller", "Lopez", "Baker", "Haupt")) and re.search(r"\d+ \w+ Street and \w+straße \d", got[2].text)
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"(?:\d{4} ?){4}", got[3].text)]
    assert len(set(cards)) == 1 and cards[0] != "4111111111111111"


def test_pii_equals_a_plain_replacement(spark):
    """On the driver's documents: the same mentions as plain patterns find in order, text between them untouched, one-to-one surrogates."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plain = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<!\w)\d{16}(?!\w)|(?<!\w)[0-9a-f]{32,64}(?!\w)")
    before = {r.doc_id: r.text for r in docs.collect()}
    known, hits = {}, 0
    for r in pii.pseudonymise(docs, "k").collect():
        text = before[r.doc_id]
        found = plain.findall(text or "")
        assert r.n_entities == len(found), (r.doc_id, found, r.entity_kinds)
        if not found:
            assert r.text == text
            continue
        gaps, at, rest = plain.split(text), 0, r.text
        for gap, mention, after in zip(gaps, found, gaps[1:], strict=False):
            assert rest[at : at + len(gap)] == gap
            at += len(gap)
            new = rest[at : at + len(mention)] if "." not in mention or "@" in mention else re.match(r"[\d.]*\d", rest[at:]).group()
            shape = lambda x: re.sub(r"[a-z]", "a", re.sub(r"\d", "0", x))
            if not re.fullmatch(r"[0-9a-f]{32,}|[\d.]+", mention):
                assert shape(new) == shape(mention)
            assert new != mention and known.setdefault(mention, new) == new
            at += len(new)
            hits += 1
        assert rest[at:] == gaps[-1]
    assert hits > 30 and len(set(known.values())) == len(known)


def test_urls(spark):
    data = [("http://A.com/en/1", "a.com", "/en/1", "com/en/", "block"), ("https://x.example.com/en/7?q#f", "x.example.com", "/en/7", "example.com/en/7", "allow"), ("ftp://e.net/de/9", "e.net", "/de/9", "net/de/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://www.z.io/p.html?utm_source=1&b=2&a=1#t", "www.z.io", "/p.html", None, "block"), ("http://z.io/q", "z.io", "/q", None, "allow"), ("", "", "", None, "allow")]
    pages = spark.createDataFrame([(k, d[0]) for k, d in enumerate(data)], "page_id long, url string")
    listed = spark.createDataFrame([("z.io/p?a=1&b=2",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, listed).collect()}
    assert got == {k: d[1:] for k, d in enumerate(data)}
    everything = urls.judge_urls(pages, listed.limit(0)).collect()
    assert len(everything) == len(data)


def test_exact(docs, rows):
    lower = lambda t: as_bytes(t).lower()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    got = exact.exact_duplicates(docs).collect()
    want = sorted(((r[0], max((x for x in groups[lower(r[1])] if x is not None), default=None), len(groups[lower(r[1])]), hashlib.sha256(lower(r[1])).hexdigest()) for r in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    stays = exact.drop_exact_duplicates(docs.select("doc_id", "text", "lang")).collect()
    assert len(stays) == len(groups)


def test_filters_merge_without_loss():
    rnd = np.random.default_rng(4)
    parts = [rnd.integers(0, 3000, 500).astype(np.uint64) << np.uint64(20) for _ in range(5)]
    built = [exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.build(p, 40, 6).to_bytes()) for p in parts]
    values, counts = exact.CountingQuotientFilter.merge(built).entries()
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert (values == want[0]).all() and (counts == want[1]).all()


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, capacity=64).collect()
    want = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    check_sequences(got, 64)
    total = sum(w[3] for w in want)
    assert len({r.sequence_id for r in got}) <= total / 64 * 1.1 + 2


def check_sequences(pieces, capacity):
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def best_fit(histogram):
    free, n = [], 0
    for length in sorted((x for x, k in histogram.items() for _ in range(k)), reverse=True):
        at = bisect.bisect_left(free, length)
        room = free.pop(at) if at < len(free) else 2048
        n += room == 2048
        bisect.insort(free, room - length)
    return n


def test_plan_places_every_piece_once():
    rnd = random.Random(9)
    histogram = {n: rnd.randrange(1, 40) for n in rnd.sample(range(1, 2049), 300)} | {2048: 5, 1: 9}
    places = packing.plan(dict(histogram))
    for length, count in histogram.items():
        own = sorted((first, many) for n, first, many, _, _ in places if n == length)
        at = 0
        for first, many in own:
            assert first == at
            at += many
        assert at == count
    ends = {}
    for length, _, many, sequence, offset in places:
        for k in range(many):
            ends.setdefault(sequence + k, []).append((offset, length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(ends) <= best_fit(histogram) * 1.01


def test_words_are_encoded_as_in_their_text():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["The CAFÉ, naïve… Straße!! don't éa x\x7fy <|endoftext|> a b \x1c ΣΑΣ,. ñ|; 12ab", "", "  \n", "ﬁ Ⅷ 漢字，テスト ..,"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode([t.encode() for t in texts])] == want


@pytest.mark.parametrize("run", [simhash.near_duplicates, shards.shard_documents, quality.quality_report, suffixes.remove_repeats, mixture.mixed, lambda d: pii.pseudonymise(d.select("doc_id", "text"), "k"), exact.exact_duplicates, packing.pack, exact.drop_exact_duplicates, mixture.apply_mix, quality.keep_good])
def test_empty_tables(empty, run):
    assert run(empty.select("doc_id", "text", "lang", "source", "n_chars")).count() == 0


def test_pipeline_stages_equal_brute_force(spark, docs, rows):
    """Every stage on its own input, with extra columns that clash with inner names."""
    kept = docs
    report = {(r.doc_id, r.n_words, r.word_chars) for r in quality.quality_report(kept).filter("kept").collect()}
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    one = stages[0](spark, kept, FOLDER)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r[0] for r in report}
    two = stages[1](spark, one, FOLDER)
    assert two.columns == docs.columns
    assert len({as_bytes(r.text).lower() for r in one.collect()}) == two.count()
    three = stages[2](spark, two, FOLDER)
    texts = [r.text for r in sorted(two.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)]
    assert three.columns == docs.columns and three.count() == len(set(similar_groups(texts)))
    four = stages[3](spark, three, FOLDER)
    shares = {r.doc_id: r for r in mixture.mixed(three).collect()}
    want = sorted(str(k) for k, r in shares.items() for _ in range(int(r.taken / r.size + 0.5) if r.size else 0))
    assert four.columns == docs.columns and sorted(str(r.doc_id) for r in four.collect()) == want
    five = stages[4](spark, four, FOLDER).collect()
    check_sequences(five, packing.CAPACITY)
    assert names == ("quality_rules", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = duck.sql(queries.ORACLE[name])
    where = [relation.columns.index(c) for c in columns]
    plain = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in where) for r in relation.fetchall()), key=str)
