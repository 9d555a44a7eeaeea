"""Substrings, language model, mixing, chat, surrogates, media and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmesh.llm import avi, chat, mixing, substring_dedup, suffix_tree, surrogates

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- substrings ----------------------------------------------------------------------------------------------------------


def brute_substrings(rows, n=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(d), len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def substrings_of(docs, cell_bytes):
    removed = F.aggregate("removed", F.lit(0), lambda a, x: a + x["stop"] - x["start"])
    got = substring_dedup.remove_repeats(docs, cell_bytes=cell_bytes).select("doc_id", "n_words", removed.alias("n"), F.sha2("kept", 256).alias("h"))
    return sorted((str(r.doc_id), r.n_words, r.n, r.h) for r in got.collect())


def test_substrings_against_brute_force(make, odd):
    rng = random.Random(7)
    passages = [prose(rng, rng.choice([12, 13, 14, 60])) for _ in range(8)] + ["same " * 40]
    rows = [*odd, (None, passages[3]), (None, passages[3])]
    for i in range(90):
        parts = [prose(rng, rng.randrange(30)), rng.choice(passages), prose(rng, 5), " ".join(rng.choice(passages).split()[rng.randrange(10) :])]
        rows.append((rng.randrange(200), "\n".join(parts)))
    expected = brute_substrings(rows)
    assert sum(e[2] for e in expected) > 1000
    for cell_bytes in (10_000_000, 8_000):
        assert substrings_of(make(rows), cell_bytes) == expected
    assert substrings_of(make(rows).limit(0), 1000) == []


# --- language model ------------------------------------------------------------------------------------------------------


def test_suffix_tree_base_and_normalisation(spark, make, odd):
    rng = random.Random(8)
    rows = list(odd)
    for i in range(200):
        w = ["start"]
        while len(w) < 60:
            w += ["new", "york", "city"] if rng.random() < 0.2 else [rng.choice(WORDS[:80])]
        rows.append((10 + i, " ".join(w)))
    out = {r.doc_id: r for r in suffix_tree.score(make([x for x in rows if x[0] != 5])).collect()}
    train = [t for d, t in rows if d != 5 and (d is None or zlib.crc32(str(d).encode()) % 5 != 1)]
    c = Counter(x for t in train for x in [*(t or "").lower().split(), "\n"])
    total, distinct = sum(c.values()), len(c)
    for d, t in rows:
        if d == 5:
            continue
        tokens = [*(t or "").lower().split(), "\n"]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens)
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[x] > 0 for x in tokens), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 1)
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert suffix_tree.score(make(rows).limit(0)).count() == 0


class BruteTree:
    """The same tree in dictionaries."""

    def __init__(self, texts, least, depth):
        self.least, self.depth, self.c = least, depth, [Counter() for _ in range(depth + 1)]
        for t in texts:
            w = [*(t or "").lower().split(), "\n"]
            for order in range(depth + 1):
                self.c[order].update(tuple(w[i : i + order + 1]) for i in range(len(w) - order))
        self.total, self.distinct = sum(self.c[0].values()), len(self.c[0])
        self.rest = {}
        for order in range(1, depth + 1):
            kept = defaultdict(dict)
            for k, n in self.c[order].items():
                if n >= least:
                    kept[k[:-1]][k[-1]] = n
            for context, entries in kept.items():
                n = self.c[order - 1][context]
                below = {x: self.p(context[1:], x) for x in entries}
                left = n - sum(entries.values())
                gain = sum(m * math.log(m / n / below[x]) for x, m in entries.items())
                gain += left * math.log(left / n / max(1 - sum(below.values()), 1e-12)) if left else 0
                if gain >= suffix_tree.MIN_G2 and gain >= suffix_tree.MIN_KL * n:
                    self.rest[context] = left + suffix_tree.DISCOUNT * len(entries)

    def p(self, context, x):
        if not context:
            return (self.c[0][(x,)] + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        below = self.p(context[1:], x)
        if context not in self.rest:
            return below
        n = self.c[len(context)][(*context, x)]
        return ((n - suffix_tree.DISCOUNT if n >= self.least else 0) + self.rest[context] * below) / self.c[len(context) - 1][context]

    def score(self, text):
        w = [*(text or "").lower().split(), "\n"]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.depth) : i]), x)) for i, x in enumerate(w))


def test_suffix_tree_against_brute_force(make, odd):
    rng = random.Random(9)
    rows = [*odd, (None, "a b c " * 50)]
    for i in range(200):
        parts = ["a b c", "d", "e b f", "New York", "new", prose(rng, 2), *(f"{x} m m m m {x}" for x in "uvw")]
        rows.append((10 + i, " ".join(rng.choice(parts) for _ in range(rng.randrange(60)))))
    learnt = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    small = {"cell_bytes": 4_000, "block_bytes": 3_000}
    for least, depth, sizes in ((32, suffix_tree.DEPTH, {}), (3, 5, small), (10**6, 4, small)):
        tree = BruteTree(learnt, least, depth)
        assert {len(context) for context in tree.rest} == (set(range(1, depth + 1)) if least < 10**6 else set())
        for context in tree.rest:  # over all words and the unknown one
            assert abs(sum(tree.p(context, w) for (w,) in tree.c[0]) + tree.p(context, "?") - 1) < 1e-9
        got = suffix_tree.score(make(rows), least=least, depth=depth, **sizes).collect()
        expected = sorted((str(d), tree.score(t)) for d, t in rows)
        for (d, x), (e, y) in zip(sorted((str(r.doc_id), r.score) for r in got), expected, strict=True):
            assert d == e and abs(x - y) < 1e-7 * max(1, abs(y))


def test_numbers_that_do_not_fit_are_refused(make):
    docs = make([(i, "a b c d e f g h") for i in range(9)])
    cells = suffix_tree.cells_of(docs, F.lit(True))
    assert suffix_tree.fit(cells, 3_200_000, 3).grams[0].where("kind = 1").agg(F.max("id")).first()[0] < 1 << suffix_tree.SHIFT
    from quillmesh.llm import blocks

    sent = blocks.send(0, np.arange(1, 400), np.full(399, 9), 1)
    with pytest.raises(OverflowError):
        blocks.counter(1, 3, True, 100)(sent)
    ids = blocks.counter(3_200_000, 3, True, 1 << 40)(sent).column("id").drop_null().to_numpy()
    assert len(ids) == 399 and ids.min() >= 0 and len(set(ids.tolist())) == 399


def test_suffix_tree_grows_with_the_corpus(make):
    rng = random.Random(10)
    texts = [" ".join(rng.choice([f"x{j} y{j} z{j}" for j in range(k, k + 5)]) for _ in range(500)) for k in range(0, 200, 5)]

    def contexts(n):
        cells = suffix_tree.cells_of(make(list(enumerate(texts[:n]))), F.lit(True))
        return suffix_tree.fit(cells, 3).states[0].count()

    few, many = contexts(10), contexts(40)
    assert few >= 2 * 50 and many >= 2 * 200 and many > 3 * few


# --- mixing --------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t | {s: 3.0 * sizes[s] for s in capped}
        capped |= set(over)


def test_mixing(make, odd):
    rng = random.Random(10)
    rows = [(d, t, "odd") for d, t in odd if d != 7]
    for s, n, m in (("a", 20, 40), ("b", 300, 80), (None, 150, 60), ("c", 5, 30), ("é", 200, 10), ("z", 3, 0)):
        rows += [(len(rows) + 100 + i, prose(rng, rng.randrange(m + 1)), s) for i in range(n)]
    docs = make(rows)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix_sizes(sized).collect()
    assert len(got) == len(rows)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size
    targets = brute_targets(dict(sizes))
    for r in got:
        assert abs(r.target - targets[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6
    again = mixing.mix_sizes(sized.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sizes(sized.limit(0)).count() == 0
    assert {r.target for r in mixing.mix_sizes(sized.where("size = 0")).collect()} == {0.0}


def test_inclusion_is_unequal_and_right(spark):
    """Over many seeds, a document is drawn about as often as its probability says."""
    sizes = spark.createDataFrame([(i, "a", 10 + 30 * (i % 4)) for i in range(60)] + [(100 + i, "b", 200) for i in range(40)], "doc_id long, source string, size long").persist()
    drawn = Counter()
    for seed in range(12):
        for r in mixing.mix_sizes(sizes, seed=str(seed)).where("source = 'b' or source = 'a'").collect():
            drawn[(r.source, r.size)] += r.copies
    rates = [drawn[("a", s)] for s in (10, 40, 70, 100)]
    assert rates == sorted(rates) and rates[0] < rates[-1]


# --- chat ----------------------------------------------------------------------------------------------------------------


def conversations(rng, n):
    turns = []
    for c in range(n):
        for t in range(rng.randrange(2, 9)):
            role = "user" if t % 2 == 0 else "assistant"
            text = prose(rng, 8) + "?" if role == "user" else "\n".join(prose(rng, 50).capitalize() for _ in range(3))
            turns.append((c, t, role, text))
    return turns


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_roles(spark):
    turns = conversations(random.Random(11), 60)
    raw = chat.observe(chat.transcripts(spark.createDataFrame(turns, TURNS), part=5))
    assert raw.agg(F.sum("n_turns")).first()[0] == len(turns) and raw.agg(F.max("n_turns")).first()[0] == 5
    parsed = chat.parse(raw, chat.fit(raw.where("conv_id < 40")))
    held = parsed.where("conv_id >= 40").agg(F.sum(chat.agreement(parsed)).alias("ok"), F.sum(F.size("lines")).alias("n")).first()
    assert held.ok / held.n > 0.9
    one = parsed.orderBy("conv_id", "part").first()
    assert one.chat.count("<|end|>") == len(one.turns) and all(r.role in chat.ROLES for r in one.turns)


def test_chat_is_decoded_as_a_whole(spark):
    """Parts of three turns and whole conversations give the same model and the same states; one conversation has no id."""
    rng = random.Random(15)
    turns = [(None if c == 7 else c, t, r, x) for c, t, r, x in conversations(rng, 25)]
    turns += [(99, t, rng.choice(chat.ROLES), rng.choice(["", "yes", "no?", "Why\n\nnot"])) for t in range(60)]
    df = spark.createDataFrame(turns, TURNS)
    whole, parts = (chat.observe(chat.transcripts(df, part=k)) for k in (10**6, 3))
    assert parts.count() > 40 and whole.count() == 26
    model, again = chat.fit(whole), chat.fit(parts)
    assert (model.start == again.start).all() and (model.see == again.see).all()

    def states(raw):
        out = defaultdict(list)
        for r in chat.parse(raw, model).select("conv_id", "part", "states").orderBy("part").collect():
            out[r.conv_id] += r.states
        return out

    assert states(whole) == states(parts)


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(16)
    for _ in range(6):
        model = chat.Model(rng.integers(-9, 0, 6), rng.integers(-9, 0, (6, 6)), rng.integers(-9, 0, (6, chat.FEATURES)))  # coarse, so that there are ties
        seen = rng.integers(0, 4, 5).tolist()
        score = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(model.see[s, x] for s, x in zip(p, seen, strict=True))  # noqa: B023, E731
        every = {p: score(p) for p in product(range(6), repeat=5)}
        best = max(every.values())
        assert tuple(model.path(seen)) == min((p for p, v in every.items() if v == best), key=lambda p: p[::-1])
        middle, _ = model.forward(seen[:3], None)
        last = model.path(seen)[-1]
        assert model.path(seen[3:], middle, last) == model.path(seen)[3:]
        assert model.entries(seen[3:], middle)[last] == model.path(seen)[2]
        assert ((middle[:, None] + model.across(seen[3:])).max(0) == model.forward(seen, None)[0]).all()


def test_chat_features():
    kinds = {observed: chat.observed(observed) for observed in ("User: hi?", "### Instructions: x", "**Assistant**: Yes", "Note: b", "plain text", "")}
    decode = lambda f: (f // 18, f // 6 % 3, f // 3 % 2, f % 3)
    assert {k: decode(f) for k, (f, _) in kinds.items()} == {"User: hi?": (2, 1, 1, 2), "### Instructions: x": (1, 1, 0, 2), "**Assistant**: Yes": (3, 1, 0, 1), "Note: b": (4, 1, 0, 2), "plain text": (0, 1, 0, 2), "": (0, 0, 0, 0)}
    assert kinds["User: hi?"][1] == 6 and kinds["Note: b"][1] == 0


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 1, "odd", "x"), (None, 1, "user", "y"), (1, 1, "odd", "x"), (2, 1, "user", "long " * 40_000)], TURNS)
    df = df.selectExpr("*", "'z' AS part", "'z' AS lines", "1 AS n", "2 AS seen")
    raw = chat.observe(chat.transcripts(df))
    parsed = chat.parse(raw, chat.fit(raw))
    assert parsed.count() == 3 and parsed.agg(F.sum("n_turns")).first()[0] == 5
    none = chat.observe(chat.transcripts(df.limit(0)))
    assert chat.parse(none, chat.fit(none)).count() == 0


# --- surrogates ----------------------------------------------------------------------------------------------------------

TEXT = (
    "Mail und.34@mail7.example.com or Und.34@Mail7.example.com, call +1 (487) 555-7209 or 487-555-7209; card 4539 5787 6362 1486, host 161.17.88.162, "
    'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", SSN 123-45-6789. Mrs. Anna Schmidt met Mr. Peter O’Hara; Анна Иванова and Maria Lopez.'
)


KEY = b"a key of the tests"


def test_surrogates_keep_type_and_reference():
    new, spans = surrogates.replaced(TEXT, KEY)
    by = defaultdict(list)
    for a, b, kind, s in spans:
        by[kind].append((TEXT[a:b], s))
    assert set(by) == {"email", "phone", "card", "ip", "secret", "ssn", "person"}
    for kind, pairs in by.items():
        for old, s in pairs:
            assert s != old and (kind in ("ip", "person") or len(s) == len(old)) and old not in new
    (e1, s1), (e2, s2) = by["email"]
    assert s1.lower() == s2.lower() and s1.endswith(".com")
    (_, p1), (_, p2) = by["phone"]
    assert p1.startswith("+1 (") and re.sub(r"\D", "", p1)[-10:] == re.sub(r"\D", "", p2)
    digits = re.sub(r"\D", "", by["card"][0][1])
    assert surrogates.luhn(digits[:-1]) == int(digits[-1])
    assert re.fullmatch(r"[0-9a-f]{40}", by["secret"][0][1])
    people = dict(by["person"])
    assert people["Anna Schmidt"].split()[0] in surrogates.GIVEN[("latin", "f")] and people["Maria Lopez"].split()[0] in surrogates.GIVEN[("latin", "f")]
    assert people["Peter O’Hara"].split()[0] in surrogates.GIVEN[("latin", "m")] and people["Анна Иванова"].split()[0] in surrogates.GIVEN[("cyrillic", "f")]
    assert surrogates.replaced(TEXT, KEY) == (new, spans) and surrogates.replaced(TEXT, b"other")[0] != new


def test_surrogates_are_distinct():
    assert len({surrogates.surrogate("ssn", f"{i:03d}-12-3456", KEY) for i in range(1000)}) == 1000
    assert sorted(surrogates.permuted(i, 777, b"k") for i in range(777)) == list(range(777))
    assert len({surrogates.surrogate("person", f"Ann{a}{b}", KEY) for a in "abcdefgh" for b in "klmnop"}) == 48
    # all secrets of a shape, hexadecimal ones among them, and all names of a shape: no two share a surrogate
    texts = [a + b + c for a in "abcdefgz" for b in "aeiou" for c in "0123456789"]
    found = {t: surrogates.surrogate("secret", t, KEY) for t in texts}
    assert len(set(found.values())) == len(texts)
    assert all(bool(surrogates.HEX.fullmatch(t)) == bool(surrogates.HEX.fullmatch(s)) for t, s in found.items())
    names = [a + b + c + d for a in "BCD" for b in "aeiou" for c in "bcdfgn" for d in ("a", "o", "ina", "ett")]
    assert len({surrogates.person(n, KEY) for n in names}) == len(names)


def test_surrogates_keep_gender_and_script():
    text = "Mrs. Zelda Fitz, Mr. Zelda Fitz, Mr. Fitz, Łukasz Čapek; Pan Łukasz Čapek, Mr. Šimon Žák, Dr. 王伟 und 王小明先生, госпожа Ольхова."
    new, spans = surrogates.replaced(text, KEY)
    (_, _, _, f), (_, _, _, m), (_, _, _, family), *rest = spans
    assert f.split()[0] != m.split()[0] and f.split()[1] == m.split()[1] == family and f.split()[0].endswith("a")
    assert [text[a:b] for a, b, _, _ in spans][3:] == ["Łukasz Čapek", "Šimon Žák", "王伟", "王小明", "Ольхова"]
    for a, b, _, s in spans:
        assert s != text[a:b] and [c.isupper() for c in s] == [c.isupper() for c in text[a:b]]
        import unicodedata

        kind = lambda x: {unicodedata.name(c).split()[0] for c in x if c.isalpha()}
        assert kind(s) == kind(text[a:b])
    assert rest[-1][3].endswith("ова")


def test_a_key_is_needed(make):
    with pytest.raises(ValueError):
        surrogates.anonymise(make([(1, "x")]), b"")


def test_clashes_and_odd_rows(make, odd):
    """Clashes of a small space are counted as a loop over all mentions counts them."""
    rng = random.Random(12)
    rows = [*odd, (50, TEXT), (51, "Mr. Šimon Žák, 王小明先生")] + [(100 + i, f"dial ({i % 100:02d}) 555{i % 900:03d} or ({rng.randrange(100):02d}) 555{rng.randrange(900):03d} now") for i in range(900)]
    docs = make(rows)
    found = surrogates.anonymise(docs, KEY)
    pairs, per_row = set(), []
    for d, t in rows:
        e = surrogates.entities(t or "")
        ids = [(surrogates.identity(k, t[a:b], g, KEY), surrogates.identity(k, surrogates.surrogate(k, t[a:b], KEY, g), g, KEY)) for a, b, k, g in e]
        pairs |= set(ids)
        per_row.append((str(d), [s for _, s in ids]))
    originals, of = {o for o, _ in pairs}, Counter(s for _, s in pairs)
    assert max(of.values()) == 1  # distinct originals, distinct surrogates
    expected = sorted((d, sum(s in originals for s in x)) for d, x in per_row)
    assert sorted((str(r.doc_id), r.n_clashes) for r in surrogates.checked(found).collect()) == expected
    out = {r.doc_id: r.text for r in found.collect()}
    assert out[1] is None and out[2] == "" and out[7] == odd[-1][1]
    assert surrogates.checked(surrogates.anonymise(docs.limit(0), KEY)).count() == 0


# --- media ---------------------------------------------------------------------------------------------------------------


def test_media_round_trip(make, odd):
    rng = random.Random(13)
    rows = [*odd[:8], (20, "".join(chr(rng.randrange(1, 0x2FF)) for _ in range(5000)))]
    docs = make(rows)
    for r in avi.digests(docs).collect():
        want = [avi.payload_of((t or "").encode()) for d, t in rows if d == r.doc_id]
        assert r.payload_sha256 in {hashlib.sha256(p).hexdigest() for p in want}
        p = next(p for p in want if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert (r.payload_bytes, r.tail_crc32) == (len(p), zlib.crc32(p[-32:])) and len(p) % 576 == 0
    media = avi.encode_media(docs)
    for r in media.collect():
        frames, rate = avi.indexed(bytes(r.media))
        assert rate == 25 and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in frames)
    clips = avi.clips(media)
    assert clips.where("last_frame < first_frame or stop_s <= start_s").count() == 0
    assert avi.digests(docs.limit(0)).count() == 0 and avi.clips(media.limit(0)).count() == 0


def test_shots_and_bad_files(spark):
    dark, light = np.zeros((20, 576), np.uint8), np.full((15, 576), 200, np.uint8)
    assert avi.cuts(avi.differences(np.concatenate([dark, light, dark]))).tolist() == [0, 20, 35]
    good = avi.stored([b"\xff" * 576 * 3])[0]
    frame = good[good.index(b"\xff\xd8") : good.index(b"\xff\xd9") + 2]
    for bad in (b"", b"RIFF\x00\x00\x00\x00WAVE", good[:60], b"RIFF\x00\x00\x00\x00AVI "):
        with pytest.raises(ValueError):
            avi.indexed(bad)
    for bad in (b"", frame[:40], frame.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8\xff\xda\x00\x02"):
        with pytest.raises(ValueError):
            avi.pictures([bad])
    # without an index, or with a wrong one, the list of frames is walked
    whole = avi.indexed(good)
    assert avi.indexed(good[: good.index(b"idx1")]) == whole and len(whole[0]) == 3
    spoilt = good[: good.index(b"idx1") + 16] + b"\x07" + good[good.index(b"idx1") + 17 :]
    assert avi.indexed(spoilt) == whole
    media = spark.createDataFrame([(1, good), (2, b"nothing"), (3, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.first_frame, r.last_frame, r.start_s, r.stop_s) for r in avi.clips(media).collect()] == [(1, 0, 2, 0.0, 0.12)]
    noise = np.random.default_rng(1).integers(0, 256, (40, 576)).astype(np.uint8)
    assert (avi.decoded(avi.coded(noise)) == noise).all()


class PlainJpeg:
    """An encoder of given quantised terms, one bit string at a time, and a decoder by the formula; nothing of the module but the standard's tables."""

    def __init__(self, rng, width, height, sampling, restart=0, tables=True):
        self.size, self.sampling, self.restart, self.tables = (width, height), sampling, restart, tables
        self.quant = [rng.integers(1, 20, 64).tolist() for _ in sampling]
        top = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.units = (-(-width // (8 * top[0])), -(-height // (8 * top[1])))
        self.blocks = []
        for _ in range(self.units[0] * self.units[1]):
            for ci, (h, v) in enumerate(sampling):
                for b in range(h * v):
                    terms = [0] * 64
                    terms[0] = int(rng.integers(-40, 40))
                    for k in rng.integers(1, 64, int(rng.integers(0, 6))):
                        terms[k] = int(rng.integers(-9, 10))
                    self.blocks.append((ci, b, terms))

    @staticmethod
    def book(k):
        counts, symbols = (bytes.fromhex(x) for x in avi.STANDARD[k])
        out, code, at = {}, 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                out[symbols[at]] = format(code, f"0{bits}b")
                code, at = code + 1, at + 1
            code <<= 1
        return out

    @staticmethod
    def bits(v):
        n = abs(v).bit_length()
        return n, (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")

    def encoded(self):
        seg = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
        n = len(self.sampling)
        out = b"\xff\xd8" + b"".join(seg(0xDB, bytes([i, *q])) for i, q in enumerate(self.quant))
        out += seg(0xC0, bytes([8]) + self.size[1].to_bytes(2, "big") + self.size[0].to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, i]) for i, (h, v) in enumerate(self.sampling)))
        if self.tables:
            out += seg(0xC4, b"".join(bytes([k]) + b"".join(bytes.fromhex(x) for x in avi.STANDARD[k]) for k in avi.STANDARD))
        if self.restart:
            out += seg(0xDD, self.restart.to_bytes(2, "big"))
        out += seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 * (i > 0)]) for i in range(n)) + bytes([0, 63, 0]))
        books = {k: self.book(k) for k in avi.STANDARD}
        per = sum(h * v for h, v in self.sampling)
        text, before, mark = "", [0] * n, 0

        def flushed():
            t = text + "1" * (-len(text) % 8)
            return int(t, 2).to_bytes(len(t) // 8, "big").replace(b"\xff", b"\xff\x00") if t else b""

        for i, (ci, _, terms) in enumerate(self.blocks):
            if self.restart and i and i % (per * self.restart) == 0:
                out, text, before = out + flushed() + bytes([255, 0xD0 + mark % 8]), "", [0] * n
                mark += 1
            size, extra = self.bits(terms[0] - before[ci])
            before[ci] = terms[0]
            text += books[int(ci > 0)][size] + extra
            run = 0
            for v in terms[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    text, run = text + books[0x10 | int(ci > 0)][0xF0], run - 16
                size, extra = self.bits(v)
                text, run = text + books[0x10 | int(ci > 0)][run << 4 | size] + extra, 0
            if run:
                text += books[0x10 | int(ci > 0)][0]
        return out + flushed() + b"\xff\xd9"

    def planes(self):
        c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
        out = [np.zeros((self.units[1] * v * 8, self.units[0] * h * 8)) for h, v in self.sampling]
        per = sum(h * v for h, v in self.sampling)
        for i, (ci, b, terms) in enumerate(self.blocks):
            unit, (h, _) = i // per, self.sampling[ci]
            y0, x0 = (unit // self.units[0] * self.sampling[ci][1] + b // h) * 8, (unit % self.units[0] * h + b % h) * 8
            for k, t in enumerate(terms):
                if t:
                    v, u = divmod(avi.ZIGZAG[k], 8)
                    for y in range(8):
                        for x in range(8):
                            out[ci][y0 + y, x0 + x] += t * self.quant[ci][k] / 4 * c(u) * c(v) * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
        return [np.clip(p + 128, 0, 255) for p in out]


@pytest.mark.parametrize(("width", "height", "sampling", "restart", "tables"), [(24, 16, [(1, 1)], 0, True), (19, 13, [(1, 1)], 2, True), (40, 25, [(2, 2), (1, 1), (1, 1)], 0, False), (33, 17, [(2, 1), (1, 1), (1, 1)], 1, False), (8, 8, [(1, 2), (1, 1)], 0, True)])
def test_decoder_on_frames_of_known_terms(width, height, sampling, restart, tables):
    rng = np.random.default_rng(width)
    plain = [PlainJpeg(rng, width, height, sampling, restart, tables) for _ in range(3)]
    for p in plain:
        p.quant = plain[0].quant
    for p, planes in zip(plain, avi.pictures([p.encoded() for p in plain]), strict=True):
        top = max(h for h, _ in sampling), max(v for _, v in sampling)
        for (h, v), got, want in zip(sampling, planes, p.planes(), strict=True):
            assert got.shape == (-(-height * v // top[1]), -(-width * h // top[0]))
            assert np.abs(got - want[: got.shape[0], : got.shape[1]]).max() <= 0.5 + 1e-6
    small = avi.decoded([p.encoded() for p in plain])
    means = [np.clip(t[0] * p.quant[0][0] / 8 + 128, 0, 255) for p in plain for ci, _, t in p.blocks if ci == 0]
    assert np.abs(np.sort(small.ravel()) - np.sort(means)).max() <= 0.5 + 1e-6


def test_features_by_a_plain_loop(make):
    """Clips of stored texts, from the payload's bytes alone."""
    rng = random.Random(17)
    texts = ["\x01" * 576 * 12 + "\x7f" * 576 * 9 + "A" * 576 * 11, prose(rng, 3000), "", "é" * 700, prose(rng, 2000) + "~" * 9000, "x" * 576 * 1030]
    got = {r.doc_id: r for r in avi.digests(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        payload = avi.payload_of(t.encode())
        frames = [payload[k : k + 576] for k in range(0, len(payload), 576)]
        counts = [Counter(b // 16 for b in f) for f in frames]
        diff = [0.0] + [sum(abs(a[k] - b[k]) for k in range(16)) / 1152 for a, b in zip(counts[1:], counts, strict=False)]
        first = [0]
        for k in range(2, len(diff)):
            past = diff[max(1, k - 8) : k]
            mean = sum(past) / len(past)
            if diff[k] > max(mean + 3 * math.sqrt(max(0.0, sum(x * x for x in past) / len(past) - mean * mean)), 0.05) + 1e-12:
                first.append(k)
        want = [(a, b - 1, a / 25, b / 25) for a, b in zip(first, [*first[1:], len(frames)], strict=True)]
        assert [(c.first_frame, c.last_frame, c.start_s, c.stop_s) for c in got[i].clips] == want
        assert got[i].feature.startswith(f"clips={len(want)};0-")
    assert len(got[0].clips) == 3


# --- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, make, odd, tmp_path):
    rng = random.Random(14)
    good = [(100 + i, prose(rng, 80)) for i in range(60)]
    junk = [(300 + i, " ".join(w + "$$$" for w in prose(rng, 80).split())) for i in range(20)]
    item = prose(rng, 20)
    rows = [*odd, *good, *junk, (500, good[0][1]), (501, f"{item} {prose(rng, 5)}")]
    rows += [(600 + i, f"{prose(rng, 40)}\nthis very line stands in a number of documents here") for i in range(7)]
    make(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0 if 300 <= d < 400 else 1, 0) for d, _ in rows if d], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert not any(300 <= d < 400 for d in seen["quality"] if d) and all(d in seen["quality"] for d, _ in good)
    assert "very line" in seen["line_dedup"][606].text and not any("very line" in seen["line_dedup"][600 + i].text for i in range(6))
    assert 100 in seen["near_dedup"] and 500 not in seen["near_dedup"]
    assert 501 in seen["near_dedup"] and 501 not in seen["decontaminate"] and 100 in seen["decontaminate"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["mixing"])


# --- damaged media -------------------------------------------------------------------------------------------------------


def test_no_damage_ends_a_job(spark):
    rng = random.Random(17)
    good = avi.stored([avi.payload_of(bytes(rng.randrange(256) for _ in range(576 * 3)))])[0]
    files = []
    for i in range(1000):
        b = bytearray(good)
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            if len(b) < 2:
                break
            a = rng.randrange(len(b)) if i % 2 else rng.randrange(min(700, len(b)))
            kind = rng.randrange(6)
            if kind == 0:
                del b[a : a + rng.randrange(1, 40)]
            elif kind == 1 and i % 5 == 0:
                del b[a + 1 :]
            else:
                b[a] = rng.choice([0, 255, rng.randrange(256)])
        files.append((i, bytes(b)))
    df = spark.createDataFrame([*files, (-1, good), (-2, None), (-3, b"")], "doc_id long, media binary").repartition(4)
    assert {r.doc_id for r in avi.clips(df).collect()} >= {-1}


# --- personal data: what is none stays, what is stays consistent --------------------------------------------------------------


@pytest.mark.parametrize("text", ["Meeting on 2024-01-15 and 15.01.2024, 3/4/2025", "pages 100 200 300", "ISBN 978-3-16-148410-0", "PanAmerican flew", "Miss You Already", "order 1234567890123456", "DE12 3456 7890 1234 5678 90"])
def test_what_is_no_personal_data_stays(text):
    assert surrogates.replaced(text, KEY) == (text, [])


def test_bounds_of_chinese_names():
    names = lambda t: [t[a:b] for a, b, k, _ in surrogates.entities(t)]
    assert names("Dr. 王伟说他今天不来了") == ["王伟"]
    assert names("今天王伟女士来了。王伟女士走了") == ["王伟"] * 2
    new = surrogates.replaced("今天王伟女士来了。王伟女士走了", KEY)[1]
    assert new[0][3] == new[1][3] != "王伟"


def test_one_person_has_one_surrogate_under_every_form():
    _, spans = surrogates.replaced("Mrs. Zelda Brown and Dr. Zelda Brown, then Ms Zelda Brown", KEY)
    assert len({s for *_, s in spans}) == 1 and len(spans) == 3


def plain_check(iban):
    n = 0
    for c in iban.replace(" ", "")[4:] + iban.replace(" ", "")[:4]:
        n = int(str(n) + str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c))) % 97
    return n


def test_ibans_and_cards_stay_valid():
    for iban in ("DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606"):
        (_, _, kind, new), = surrogates.replaced(f"to {iban} now", KEY)[1]
        assert kind == "iban" and new != iban and new[:2] == iban[:2] and len(new) == len(iban) and plain_check(new) == plain_check(iban) == 1
    for card in ("4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"):
        (_, _, kind, new), = surrogates.replaced(f"card {card}.", KEY)[1]
        digits = [int(c) for c in new if c.isdigit()][::-1]
        assert kind == "card" and new != card and (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def test_detection_against_planted_entities():
    """Precision and recall over texts whose entities are known because they were put there."""
    rng = random.Random(23)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    body = lambda: rng.choice("3456") + digits(14)
    makers = {
        "email": lambda: f"{rng.choice(['jo', 'ann.li', 'x_9'])}{digits(2)}@{rng.choice(['mail', 'post'])}.example.{rng.choice(['org', 'com'])}",
        "phone": lambda: rng.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"+49 30 {digits(4)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        "card": lambda: (lambda b: b + str(surrogates.luhn(b)))(body()),
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "person": lambda: f"{rng.choice(['Mr.', 'Mrs.', 'Dr.'])} {rng.choice(['Zelda', 'Quentin', 'Ilse'])} {rng.choice(['Brown', 'Okafor', 'Nowak'])}",
    }
    clean = ["on 2023-11-05", "pp. 12-19", "section 3.4.1", "version 10.2", "in 1999 and 2001", "100 200 300", "ISBN 978-3-16-148410-0", "12:30:45", "3,141,592", "room 404"]
    found = right = planted = 0
    for _ in range(400):
        parts, truth, at = [], [], 0
        for _ in range(6):
            kind = rng.choice([*makers, None, None])
            piece = makers[kind]() if kind else rng.choice(clean)
            parts.append(f"some words {piece} here")
            if kind:
                start = at + len("some words ") + (piece.index(" ") + 1 if kind == "person" else 0)
                truth.append((start, at + len("some words ") + len(piece), kind))
            at += len(parts[-1]) + 2
        got = {(a, b, k) for a, b, k, _ in surrogates.entities("; ".join(parts))}
        found, right, planted = found + len(got), right + len(got & set(truth)), planted + len(truth)
    assert right / planted > 0.99 and right / found > 0.99, (right, found, planted)
