"""Repeated paragraphs and near copies against brute force written apart from the operators."""

import random
import re

import pytest

from twigmer.llm import links, near_copies, paragraphs


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(words):
    return frozenset(zip(*[words[i:] for i in range(5)], strict=False))


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def similar_pairs(sets):
    """All pairs of names at Jaccard similarity 0.8 or more, tried two by two."""
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common and 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                yield a, b


def shared_characters(rows, min_words):
    """By row: the characters of words in a run of min_words words that another document has too."""
    owners = {}
    for doc, text in rows:
        words = words_of(text)
        for i in range(len(words) - min_words + 1):
            owners.setdefault(tuple(words[i : i + min_words]), set()).add((doc, text))
    out = []
    for _, text in rows:
        words, spans, own = words_of(text), [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")], set()
        for i in range(len(words) - min_words + 1):
            if len(owners[tuple(words[i : i + min_words])]) > 1:
                own.update(range(spans[i][0], spans[i + min_words - 1][1]))
        out.append(own)
    return out


def check_paragraphs(spark, rows, min_words, min_line_words=5):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in paragraphs.repeated_paragraphs(frame, min_words=min_words, min_line_words=min_line_words).collect()]
    long = {r.doc_id for r in got if r.n_words >= min_words}
    ids = [d for d, _ in rows]
    assert all(r.long_repeat == (r.doc_id in long) for r in got if ids.count(r.doc_id) == 1)
    # runs of words, by their characters
    want = {}
    for (doc, text), own in zip(rows, shared_characters(rows, min_words), strict=True):
        if own:
            want.setdefault(doc, set()).update((text, c) for c in own)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(text)
    found = {}
    for r in got:
        if r.kind != "line":
            assert r.n_words >= min_words
            for text in texts[r.doc_id]:
                if len(texts[r.doc_id]) == 1:
                    part = text[r.start : r.start + r.n_chars]
                    assert len(words_of(part)) == r.n_words
                    blank = {m.start() for m in re.finditer(r"[\x20\x09-\x0D]", text)} if r.kind == "text" else set()
                    found.setdefault(r.doc_id, set()).update((text, c) for c in range(r.start, r.start + r.n_chars) if c not in blank)
    visible = lambda xs: {(t, c) for t, c in xs if not re.match(r"[\x20\x09-\x0D]", t[c])}
    one = {d for d, t in texts.items() if len(t) == 1}
    assert {d: visible(x) for d, x in found.items() if d in one} == {d: visible(x) for d, x in want.items() if d in one}
    assert set(want) == {r.doc_id for r in got if r.kind != "line"}
    # lines
    places, sets = [], {}
    for doc, text in rows:
        at = 0
        for n, line in enumerate((text or "").split("\n")):
            if len(words_of(line)) >= min_line_words:
                name = tuple(words_of(line))
                places.append((name, doc, n, at, len(line), text))
                sets[name] = shingles(name)
            at += len(line) + 1
    root = components(sets, similar_pairs(sets))
    groups = {}
    for name, *place in places:
        groups.setdefault(root[name], []).append(place)
    want = sorted(sorted(str(p[:4]) for p in v) for v in groups.values() if len({(p[0], p[4]) for p in v}) > 1)
    lines = {}
    for r in got:
        if r.kind == "line":
            lines.setdefault(r.component, []).append(r)
    assert sorted(sorted(str([r.doc_id, r.number, r.start, r.n_chars]) for r in v) for v in lines.values()) == want
    for v in lines.values():
        assert len({r.component_id for r in v}) == 1 and any(not r.removed for r in v) and any(r.removed for r in v)
    return got


def test_paragraphs_of_odd_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 8)  # several blocks in a bucket
    assert paragraphs.tuned_bands(paragraphs.ROWS) <= paragraphs.BANDS
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(500 + k, "\n".join(["head " * 12 + str(k), " ".join([*base[: (p := rng.randrange(60))], f"v{k}", *base[p + 1 :]])])) for k in range(120)]
    rows += [(1500, rows[-1][1]), (1501, "One two three four five six seven eight nine ten " * 2), (1502, "zero\none Two three four five six seven eight nine ten " + "one two three four five six seven eight nine ten")]
    rows += [(1503, "many " * 4000 + " ".join(base)), (1504, "long " * 30000 + " ".join(base) + " z" * 30000)]
    rows += [(1600 + k, t) for k, t in enumerate(["a b a b a b a b a b", "a b a b a b", "b a b a b a", "x\na b c d e f\ny", "a b c d e f g h", "a b c d e f g h i", "five words are one shingle", "zz\nFive words are one shingle"])]
    got = check_paragraphs(spark, rows, 20, 20)
    assert check_paragraphs(spark, rows, 20) != got
    assert {1501, 1502, 1503, 1504} <= {r.doc_id for r in got}
    assert check_paragraphs(spark, rows[:-2], 51)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert paragraphs.repeated_paragraphs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        paragraphs.repeated_paragraphs(frame, min_words=5)
    with pytest.raises(ValueError):
        paragraphs.repeated_paragraphs(frame, min_line_words=4)


def test_passages_of_51_words_are_found_wherever_they_stand(spark):
    rng = random.Random(22)
    word = lambda: f"é{rng.randrange(10**6)}"
    rows, inside = [], {}
    for i in range(60):
        passage = [word() for _ in range(51 + i // 4 if i % 2 else 50)]
        for d in (2 * i, 2 * i + 1):
            breaks = [" \t" if rng.random() < 0.95 else "\n" for _ in passage]
            text = "".join(w.upper() + b if d % 3 else w + b for w, b in zip(passage, breaks, strict=True))
            rows.append((d, " ".join(word() for _ in range(rng.randint(0, 300))) + " " + text + " ".join(word() for _ in range(rng.randint(1, 300)))))
            inside[d] = len(passage)
    got = check_paragraphs(spark, [(d, t.replace("É", "é")) for d, t in rows], 51)
    passages = {r.doc_id: r for r in got if r.kind == "passage"}
    assert set(passages) == {d for d, n in inside.items() if n > 50}
    for d, r in passages.items():
        assert r.n_words == inside[d] and r.removed == (d % 2 == 1) and r.component_id == d - d % 2


def test_paragraphs_of_the_smallest_table(spark, sf0001):
    check_paragraphs(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf0001}/documents.parquet").collect()], 51)


def test_near_copies_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 8)
    rng = random.Random(21)
    rows = []
    for i in range(60):  # 3 changed words of 100 leave a similarity of about 0.74 to 0.82, 2 of 0.81 to 0.9
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append((5000 + 10 * i, " ".join(base)))
        for k, changed in enumerate((1, 2, 2, 3)):
            new = list(base)
            for p in rng.sample(range(100), changed):
                new[p] = "new"
            rows.append((5001 + 10 * i + k, " ".join(new)))
    common = [f"c{i}" for i in range(100)]
    rows += [(9000 + i, " ".join([*common[: (p := rng.randrange(100))], f"x{i}", *common[p + 1 :]])) for i in range(60)]
    rows += [(9900, "a b c d"), (9901, "A  b c\nd"), (9902, "a b c e"), (9903, "very " * 60000 + "long"), (9904, "very " * 60000 + "long indeed")]
    more = docs.unionByName(spark.createDataFrame([(d, t, "en", "", len(t)) for d, t in rows], docs.schema))
    texts = {tuple(words_of(r.text)) for r in more.collect()}
    root = components(texts, similar_pairs({t: shingles(t) for t in texts}))
    name = {}
    for r in more.collect():
        name.setdefault(r.doc_id, set()).add(root[tuple(words_of(r.text))])
    got = near_copies.near_copies(more).collect()
    assert len(got) == more.count()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.component)
    single = sorted(d for d, n in name.items() if d is not None and len(n) == 1)
    partition = lambda of: sorted(sorted(d for d in single if min(of[d]) == c) for c in {min(of[d]) for d in single})
    assert partition(found) == partition(name)
    kept = near_copies.keep_one(more)
    assert kept.columns == more.columns and kept.count() == len(set(root.values()))
    assert {r.doc_id for r in kept.collect()} >= {5000 + 10 * i for i in range(60)} | {9900, 9902, 9903}
    assert near_copies.keep_one(more.limit(0)).count() == 0


def test_members_that_meet_no_other_component_are_not_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 8)
    rng = random.Random(23)
    bits, dealt = near_copies.SEGMENT_BITS, []
    prints = lambda: [rng.randrange(1 << bits) for _ in range(near_copies.SEGMENTS)]
    weak = [1 << i for _ in range(near_copies.SEGMENTS) for i in range(near_copies.WEAK_BITS)]
    compared = links._compared

    def spy(rows, near, ids_only):
        cells = rows.selectExpr("id", "inline(cells)").selectExpr("sum(n) + sum(if(fails, m, 0)) as dealt", "count(*) as members").first()
        dealt.append((cells.dealt, cells.members))
        return compared(rows, near, ids_only)

    def linked(rows):
        dealt.clear()
        nodes = spark.createDataFrame([(i, b"%d" % i, i, segments, weak) for i, segments, _ in rows], "id long, one binary, doc long, segments array<int>, weak array<int>")
        texts = spark.createDataFrame([(b"%d" % i, i, text) for i, _, text in rows], "text_key binary, doc long, text string")
        return [tuple(r) for r in near_copies._links(nodes, texts).collect()]

    monkeypatch.setattr(links, "_compared", spy)
    other = lambda: " ".join(f"o{rng.randrange(10**9)}" for _ in range(100))
    # each meets the first by chance in a bucket of its own
    head = prints()
    rows = [(0, head, other())]
    for i in range(33):
        rows.append((1 + i, [*(p := prints())[:i], head[i], *p[i + 1 :]], other()))
    assert linked(rows) == [] and dealt == []
    # near copies meet an unlike first in one bucket, and then one more text, too, of which one is a copy
    base, words = prints(), [f"w{i}" for i in range(100)]
    copy = lambda: " ".join([*words[: (p := rng.randrange(100))], "new", *words[p + 1 :]])
    rows = [(0, [base[0], *prints()[1:]], other())] + [(1 + i, base, copy()) for i in range(40)]
    roots = components(range(41), linked(rows))
    assert len({roots[i] for i in range(1, 41)}) == 1 and roots[0] != roots[1] and dealt == []
    rows.append((41, [base[0], *prints()[1:]], other()))
    roots = components(range(42), linked(rows))
    assert len({roots[i] for i in range(1, 41)}) == 1 and len(set(roots.values())) == 3
    assert len(dealt) == 1 and dealt[0][1] == 41 and dealt[0][0] <= 2 * 41
    # its link with some of them isn't lost: it is near those alone that aren't the first
    far = [b ^ (0xFF if i else 0) for i, b in enumerate(base)]
    mid = [b ^ (0xF if i else 0) for i, b in enumerate(base)]
    last = words[:4] + [f"m{i}" for i in range(6)] + words[10:]
    end = last[:90] + [f"e{i}" for i in range(6)] + last[96:]
    rows = rows[:41] + [(50, mid, " ".join(last)), (51, far, " ".join(end))]
    assert len(set(components([r[0] for r in rows], linked(rows)).values())) == 2


def test_copies_that_differ_in_other_columns_leave_the_least(spark):
    rows = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "y"), (2, "A b", "x")], "doc_id long, text string, `o.k` string")
    assert [tuple(r) for r in near_copies.keep_one(rows).collect()] == [(1, "a b", "y")]
