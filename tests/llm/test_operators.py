"""The operators of the llm subpackage against brute force on small fixtures with odd rows."""

import base64
import hashlib
import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from twigmer.llm import balance, bpe, decontaminate, media, pii, simhash, token_files, toxicity, warc
from twigmer.llm._shared import connected_components
from twigmer.llm.queries import vocabulary

from odd_rows import ODD

def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None)


def by_row(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


# ---- op1


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 30),) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_archives(spark):
    rows = [(1, "http://x.com/a", "é\r\n\r\n"), (0, "http://www.X.com:80/a#f", "é\r\n\r\n"), (2, None, None), (3, "u", ""), (None, "q", "é\r\n\r\n"), (0, "http://www.X.com:80/a#f", "é\r\n\r\n"), (None, "n", "only"), (7, "u\r\nX: y", "WARC/1.1\r\n\r\n"), (8, "big", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_report(pages).collect()
    least = {}
    for i, _, h in rows:
        least.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        ids = [x for x in least[h or ""] if x is not None]
        first = min(ids) if ids else None
        b = (h or "").encode()
        revisit = first is not None and i != first
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert by_row(got, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == sorted(want, key=str)
    merged = sorted(got, key=lambda r: r.history_rank)
    assert [r.history_rank for r in merged] == list(range(len(rows)))
    order = [(r.urlkey, r.captured, r.page_id is not None, r.page_id or 0) for r in merged]
    assert order == sorted(order)
    assert {r.urlkey for r in got if r.page_id in (0, 1)} == {"com,x)/a"}
    assert warc.archive_report(pages.limit(0)).count() == 0


# ---- op2


def test_gear_cuts_find_the_same_places_after_an_insertion():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    a = {d for d, _ in media.chunks_of(data)}
    b = {d for d, _ in media.chunks_of(data[:1000] + b"inserted" + data[1000:])}
    assert len(a & b) >= len(a) - 3
    sizes = np.diff([0, *media.gear_cuts(data)])
    assert sizes.sum() == len(data) and sizes.max() <= media.MOST and (sizes[:-1] >= media.LEAST).all()


def test_media(spark, docs):
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, ("shared passage " * 3000) + str(i)) for i in range(4)], "doc_id long, text string"))
    got = media.media_report(more).collect()
    want = []
    for r in more.collect():
        b = (r.text or "").encode()
        p = b + b" " * (-len(b) % 192) or b" " * 192
        w = media.wav(p)
        want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(w), hashlib.sha256(w).hexdigest()))
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    assert by_row(got, columns) == sorted(want, key=str)
    assert len({(r.payload_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.media_report(more.limit(0)).count() == 0


def test_chunks_that_occur_again_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, ("shared passage " * 3000) + str(i)) for i in range(5)], "doc_id long, text string")
    media.write_media(rows, str(tmp_path / "m"))
    files, chunks = spark.read.parquet(str(tmp_path / "m/files")), spark.read.parquet(str(tmp_path / "m/chunks"))
    refs = files.select(F.explode("chunks").alias("c")).where("c.bytes is null")
    assert chunks.count() == refs.select("c.digest").distinct().count() > 0
    assert chunks.count() < refs.count()


# ---- op3


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = docs.select("doc_id", "text")
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    got = token_files.token_report(rows, path).orderBy("start").collect()
    start, want = 0, []
    for g in got:
        assert g.start == start
        start += g.n_tokens
    for r in rows.collect():
        t = ids(r.text)
        want.append((r.doc_id, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
    assert by_row(got, ["doc_id", "n_tokens", "ids_crc32"]) == sorted(want, key=str)
    assert [g.doc_id or -1 for g in got] == sorted(g.doc_id or -1 for g in got)
    assert token_files.token_report(rows.limit(0), path).count() == 0
    token_files.write_token_files(rows, str(tmp_path / "t"), path, 2)
    one = token_files.read_token_files(spark, str(tmp_path / "t"), [6])
    assert [r.ids for r in one.collect()] == [ids(ODD[6])]
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*doc_id", plan)


# ---- op4


def _toxic(rng, n=400):
    words = [f"{a}{b}" for a in ("tha", "ere", "ing", "onn", "ati") for b in ("sh", "nd", "ble", "ly", "er", "st")]
    bad = ["idiot", "moron", "scumbag"]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(10, 200))]
        if i % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxicity_of_held_out_texts_and_unseen_misspellings():
    texts, labels = _toxic(random.Random(4))
    model = toxicity.train(texts, labels)
    score = lambda t: toxicity._logistic(toxicity.worst_passage(toxicity.word_scores(toxicity.split(t), model.weights) if t.split() else np.zeros(0))[0] + model.bias)
    fresh, truth = _toxic(random.Random(5), 200)
    assert np.mean([(score(t) >= 0.5) == bool(y) for t, y in zip(fresh, truth, strict=True)]) > 0.97
    clean = "thash erend ingble onnly atier thash erest ingnd"
    assert score(clean + " idiiot " + clean) > score(clean + " erend " + clean)


def test_toxicity_rows(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(12, 18)] + [(99, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.toxicity_report(docs, none).count() == docs.count()
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


# ---- op6


def _fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {n for e in edges if e[0] != e[1] for n in e}
    assert got == _components([e for e in edges if e[0] != e[1]], used)
    assert connected_components(spark.createDataFrame(edges, "a long, b long").limit(0)).count() == 0


def test_near_fingerprints_equal_all_pairs(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:120]:
        for n in (1, 2, 3, 4):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {(r.a, r.b) for r in simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(got) > 300


def test_simhash(spark, docs):
    rows = [(r.doc_id, _fingerprint(r.text)) for r in docs.collect()]
    nodes = {f for _, f in rows}
    root = _components([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3], nodes)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in rows), key=str)
    assert by_row(simhash.simhash_report(docs).collect(), ["doc_id", "fingerprint", "component_id"]) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root.values()))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} >= set(least.values()) - {None}
    assert simhash.simhash_report(docs.limit(0)).count() == 0


# ---- op7


def test_differencing_deals_evenly():
    rng = np.random.default_rng(9)
    sizes = rng.integers(100, 5000, 800)
    sums, lanes = balance.difference([balance._single(int(s), 8) for s in sizes])
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 40
    again = np.zeros(8, np.int64)
    for s, lane in zip(sizes, lanes, strict=True):
        again[lane[0]] += s
    assert (again == sums).all()


def test_shards(spark, docs):
    rng = random.Random(10)
    texts = ["copy " * 30] * 40 + ["huge " * 4000] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 900))) for _ in range(1500)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = balance.shard_documents(more, 7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert by_row(got, ["doc_id", "size", "text_crc32"]) == sorted(((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in more.collect()), key=str)
    shards, homes = {}, {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert set(shards) == set(range(7)) and all(len(h) == 1 for h in homes.values())
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    loads = [sum(r.size for r in v) for v in shards.values()]
    assert max(loads) - min(loads) < 0.005 * max(loads)
    assert balance.shard_documents(more.limit(0), 7).count() == 0


def test_a_group_above_the_mean_has_a_shard_to_itself(spark):
    rows = spark.createDataFrame([(0, "z" * 90_000)] + [(i, f"t{i}" * 30) for i in range(1, 400)], "doc_id long, text string")
    got = balance.shard_documents(rows, 5).collect()
    alone = next(r.shard for r in got if r.doc_id == 0)
    assert [r.doc_id for r in got if r.shard == alone] == [0]
    loads = {}
    for r in got:
        if r.shard != alone:
            loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert len(loads) == 4 and max(loads.values()) - min(loads.values()) < 300


# ---- op8


@pytest.fixture(scope="module")
def byte_encoder():
    return bpe.ByteEncoder(vocabulary("byte_bpe_50k.json"))


def test_joined_halves_equal_the_whole(byte_encoder):
    rng = random.Random(11)
    kinds = [["abc", "the", "XY1", "é", "ß", "日本", "!!", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", "9", "😀", " ", "́", "-"], ["a", "b", "the", "ing"], ["日本", "語", "ん"], ["!", "'", "?", "--"], [" ", "  ", "\n"], ["7", "12"]]
    for n in range(600):
        t = "".join(rng.choice(kinds[n % len(kinds)]) for _ in range(rng.randint(150, 700)))
        cut = rng.randint(1, len(t) - 1)
        want = byte_encoder.library.encode(t, add_special_tokens=False).ids
        assert byte_encoder.whole(t).tolist() == want
        both = bpe.join_halves(byte_encoder, (t[:cut], byte_encoder.whole(t[:cut])), (t[cut:], byte_encoder.whole(t[cut:])))
        assert both[0] == t and both[1].tolist() == want


def test_bpe(spark, docs, byte_encoder):
    path, library = vocabulary("byte_bpe_50k.json"), byte_encoder.library
    long = ["日本語" * 3000, "word next " * 2000, "a" * 20_000, " " * 9000 + "x", "12345" * 3000, "<|endoftext|>" * 900]
    more = docs.unionByName(spark.createDataFrame([(2000 + i, t, "", "", 0) for i, t in enumerate(long)], docs.schema))
    got = bpe.decode(bpe.encode(more, path, out="tokens", leaf_chars=1024), path, ids="tokens")
    assert got.columns == ["doc_id", "lang", "ids", "n_chars", "text", "tokens", "decoded"]
    for r in got.collect():
        assert r.tokens == library.encode(r.text, add_special_tokens=False).ids
        assert r.decoded == library.decode(r.tokens, skip_special_tokens=False)
    report = bpe.roundtrip(more, path).collect()
    want = []
    for r in more.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert by_row(report, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=str)
    assert bpe.roundtrip(more.limit(0), path).count() == 0


# ---- op9


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("broadcast", [50_000, 3])
def test_contamination(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    span = "The quick BROWN fox, jumps; over the-lazy dog and runs away from"
    rows = [(700, "zz " + span + " zz"), (701, span.replace("fox", "ox")), (702, "x " * 60), (703, span + " " + span), (704, "BAZ é baz É")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame([(10, span), (9, span + " more words here"), (2, "foo bar"), (3, ""), (4, None), (5, "baz É"), (6, "x x x x x x x x x x x"), (None, "alpha beta"), (2, "foo bar")], "item_id long, text string")
    wins = {}
    for r in items.collect():
        w = _words(r.text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(r.item_id)
    want = []
    for r in more.collect():
        w, hit, found = _words(r.text), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= x
        names = sorted(str(i) for i in found if i is not None)
        want.append((r.doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert by_row(decontaminate.contamination(more, items).collect(), columns) == sorted(want, key=str)
    assert decontaminate.contamination(more, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(more.limit(0), items).count() == 0
    clean = decontaminate.keep_clean(more, items)
    assert clean.columns == more.columns and clean.count() == sum(not w[5] for w in want)


# ---- op10


def _luhn(d):
    return sum((v * 2 - 9 if v > 4 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def _base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]


PERSONAL = [
    "a@b.c%x@d.e a@b.c@d.e 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255",
    "+1 (234) 567-8901. card 4111 1111 1111 1111 é4111-1111-1111-1112 😀 x@y.z +49 30 1234567 call",
    "bank IBAN GB82 WEST 1234 5698 7654 32, GB82 WEST 1234 5698 7654 33; ssn 123-45-6789",
    "nothing 123-45-6789 here",
    "1 " * 9000 + "." * 500 + "+1(" * 200,
    "a@b.co " * 800,
    "x" * 3000,
]


def test_personal_data(spark, docs):
    rng = random.Random(12)
    pieces = ["a", "b1", "@", ".", "-", " ", "+", "4111", "1", "(", ")", "é", "255", "%"]
    rows = [(3000 + i, t) for i, t in enumerate(PERSONAL + ["".join(rng.choice(pieces) for _ in range(rng.randint(10, 80))) for _ in range(300)])]
    more = docs.select("doc_id", "text", F.lit(1).alias("pii"), "lang").unionByName(spark.createDataFrame([(*r, 1, "") for r in rows], "doc_id long, text string, pii int, lang string"))
    got = pii.find_pii(more).collect()
    assert pii.find_pii(more).columns == ["doc_id", "text", "pii", "lang"]
    for r in got:
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.kind in pii.BASE_KINDS]
        assert base == _base_spans(r.text)
        assert all(s.value == r.text[s.start : s.end] and 0 < s.score <= 1 for s in r.pii)
    added = {r.doc_id: [s.kind for s in r.pii if s.kind not in pii.BASE_KINDS] for r in got}
    assert added[3002] == ["iban", "ssn"] and added[3003] == []
    for r in pii.pii_report(more).collect():
        if r.doc_id is not None and r.doc_id >= 3000:
            base = _base_spans(rows[r.doc_id - 3000][1])
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.BASE_KINDS]
    assert pii.pii_report(more.limit(0)).count() == 0


def test_redaction(spark):
    rows = spark.createDataFrame([(0, "😀 mail a@b.co, card 4111 1111 1111 1111!"), (1, None), (2, "plain"), (3, "b@1.2.3.4 +49 30 1234567")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(pii.find_pii(rows)).collect()}
    assert got == {0: "😀 mail <EMAIL>, card <CARD>!", 1: None, 2: "plain", 3: "<EMAIL> <PHONE>"}


def test_numbers_of_known_validity(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"), ("4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 33")], "card string, iban string")
    assert [tuple(r) for r in df.select(pii.luhn_ok(F.col("card")), pii.mod97_ok(F.col("iban"))).collect()] == [(True, True), (False, False)]


def test_running_sums(spark):
    values = [random.Random(13).randint(0, 9) for _ in range(101)]
    df = spark.createDataFrame([(values[:n],) for n in (0, 1, 2, 50, 101)], "v array<int>")
    for v, s in df.select("v", pii.running_sums(F.col("v"))).collect():
        assert s == [sum(v[:i]) for i in range(len(v))]


# ---- everything together


def test_main_paths_of_native_operators_run_no_python(spark, docs):
    for df in (pii.find_pii(docs), decontaminate.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(3))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="no driver tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    out = corpus_pipeline.run(spark, str(DATA))
    kept = {r.doc_id for r in out.collect()}
    assert len(kept) == out.count() <= n
    rest = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rest = spark.createDataFrame(stage(spark, rest, str(DATA)).collect(), docs.schema)
        assert rest.columns == columns, name
    assert {r.doc_id for r in rest.collect()} == kept
    assert not pii.find_pii(rest).where(F.exists("pii", lambda s: s["kind"] == "email")).count()


@pytest.mark.skipif(not DATA.is_dir(), reason="no driver tables")
def test_queries_equal_duckdb(spark):
    import duckdb

    from twigmer.llm import queries

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    for name, sql in queries.ORACLE_SQL.items():
        rel = con.sql(sql)
        columns = sorted(rel.columns)
        df = queries.QUERIES[name](spark, str(DATA))
        assert sorted(df.columns) == columns
        assert by_row(df.collect(), columns) == sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=str), name


def test_budget_of_names():
    from twigmer.llm import queries

    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert json.dumps(queries.ORACLE_SQL)


def test_many_spans_in_a_long_text_stay_linear(spark):
    """40 000 spans in one text of over 1 MB; places by a plain search, redaction by replacing."""
    import time

    text = "".join(f"é{i} u{i}@mail.example.org, " for i in range(40_000))
    frame = spark.createDataFrame([(1, text, "x"), (2, "call +49 30 1234567 now " + "é" * 5000 + " a@b.cc", None), (3, "", None)], "doc_id long, text string, lang string")
    pii.find_pii(frame.where("doc_id > 1")).collect()  # workers and code are warm
    began = time.time()
    found = {r.doc_id: r for r in pii.redact(pii.find_pii(frame)).collect()}
    took = time.time() - began
    spans = [(m.start(), m.end()) for m in re.finditer(r"u\d+@mail\.example\.org", text)]
    assert [(s.start, s.end) for s in found[1].pii if s.kind == "email"] == spans
    assert all(s.score == 1.0 for s in found[1].pii)  # "mail" stands near all of them
    assert found[1].text == re.sub(r"u\d+@mail\.example\.org", "<EMAIL>", text)
    assert found[2].text == "call <PHONE> now " + "é" * 5000 + " <EMAIL>" and found[3].text == ""
    assert took < 30


def naive_toxicity(text, model):
    """The softmax's probability of the worst passage, n-gram by n-gram."""

    def places(word):
        raw = b"<" + word.encode() + b">"
        grams = [zlib.crc32(raw)]
        for n in toxicity.NGRAMS:
            for i in range(len(raw) - n + 1):
                h = 0
                for k, byte in enumerate(raw[i : i + n]):
                    h = (h * 0x01000193 + byte + k + 1) % (1 << 32)
                grams.append(h)
        return [g * 2654435761 % (1 << 32) >> (32 - toxicity.BUCKET_BITS) for g in grams]

    values = []
    for word in (text or "").lower().split():
        own = places(word.strip(toxicity._EDGES) or word)
        value = sum(model.weights[p] for p in own) / len(own)
        if not values or abs(values[-1] - value) > 0:  # a word that follows itself counts once
            values.append(value)
    n = min(len(values), toxicity.PASSAGE_WORDS)
    worst = max((sum(values[i : i + n]) / toxicity.PASSAGE_WORDS for i in range(len(values) - n + 1)), default=0.0) if values else 0.0
    logits = np.array([0.0, worst + model.bias])
    return float(np.exp(logits[1]) / np.exp(logits).sum())


def test_toxicity_scores_equal_naive_recomputation(spark, docs):
    model = toxicity.train(*_toxic(random.Random(4)))
    fresh = spark.createDataFrame([(3000 + i, t) for i, t in enumerate(_toxic(random.Random(5), 80)[0])], "doc_id long, text string")
    got = toxicity.score(docs.select("doc_id", "text").unionByName(fresh), model).collect()
    assert len({round(r.score, 6) for r in got}) > 50
    assert all(abs(r.score - naive_toxicity(r.text, model)) < 1e-9 for r in got)


def test_long_texts_are_learnt_from(spark):
    """A class whose texts are all long: no text is left out of the sample for its length."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        words = prose(6000 if i % 2 else 60)
        if i % 2:
            for _ in range(40):
                words.insert(rng.randrange(len(words)), "scumbag idiot moron")
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    assert min(len(t) for i, t in rows if i % 2) > toxicity.PIECE_CHARS
    docs, labels = spark.createDataFrame([*rows, (7, "zzz"), (7, "zzz")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, labels).where("doc_id <> 7").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) > 0.95 * len(got)


def test_sample_is_learnt_from_in_a_task(spark, monkeypatch):
    """The driver meets no text to learn from, and the model is that of all texts at once."""
    texts, marks = _toxic(random.Random(6), 120)
    seen = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    want = toxicity.train([texts[i] for i in seen], [marks[i] for i in seen])

    def refuse(*_):
        raise AssertionError("trained in the driver")

    for name in ("train", "learn"):
        monkeypatch.setattr(toxicity, name, refuse, raising=False)
    got = toxicity.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"))
    assert np.array_equal(got.weights, want.weights) and got.bias == want.bias
