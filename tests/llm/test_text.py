"""Packing, secrets, tokens, languages, language model and fingerprints against brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import class_lm, language_id, lz_fingerprint, packing, piece_bpe, secrets
from palimpsest.llm import queries as Q
from palimpsest.llm.key_ranges import first_keys, range_of

SCHEMA = "doc_id long, text string, lang string, spans string, score string, ids string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, x[0] if x else None, "s", "t", None) for d, t, *x in rows], SCHEMA)


def texts_of(spark, sf):
    return {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a" * 30_000), (5, "É漢字🙂 <s> ▁▁x  y"), (5, "É漢字🙂 <s> ▁▁x  y"), (6, "Hello  world\r\n\nthe don't <|endoftext|>x")]


def check_packing(rows, got, limit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_file("word_bpe_49k.json"))
    want = collections.Counter()
    total = 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), limit):
            own = np.array(ids[k : k + limit], "<u4").tobytes()
            want[d, k // limit, k, len(own) // 4, zlib.crc32(own)] += 1
    assert collections.Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    sequences = collections.defaultdict(list)
    for x in got:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), -(-total // limit)


def test_packing(spark):
    rows = [(d, t) for d, t, *_ in ODD] + [(10 + i, "word thing " * (i % 37)) for i in range(200)]
    n, least = check_packing(rows, packing.packed_documents(docs(spark, rows), Q.tokenizer_file("word_bpe_49k.json"), limit=64).collect(), 64)
    assert n <= least + 2
    assert packing.packed_documents(docs(spark, []), Q.tokenizer_file("word_bpe_49k.json")).count() == 0


def test_packing_over_several_levels(spark):
    rows = [(i, "word thing " * (i % 29)) for i in range(600)]
    made = packing.pieces(docs(spark, rows), Q.tokenizer_file("word_bpe_49k.json"), 64, 1)
    n, least = check_packing(rows, packing.pack(made, 64, shard_size=20, open_share=64).collect(), 64)
    sizes = [x["length"] for x in made.select("length").collect()]
    assert n <= 1.04 * len(packing.pack_sizes(sizes, 64)) + 1


def test_packing_query(spark, sf):
    n, least = check_packing(list(texts_of(spark, sf).items()), Q.op4_best_fit_packing(spark, sf).collect(), 4096)
    assert n <= least + 1


def test_local_search_raises_squared_fill():
    r = random.Random(1)
    for _ in range(60):
        sizes = [r.randint(1, 60) for _ in range(r.randint(2, 60))]
        bins = packing.Bins(100)
        order = list(range(len(sizes)))
        r.shuffle(order)
        for i in order:  # a poor start: next fit
            if not bins.items or bins.room[-1] < sizes[i]:
                bins.items.append([])
                bins.room.append(100)
            bins.items[-1].append(i)
            bins.room[-1] -= sizes[i]
        before = sum((100 - x) ** 2 for x in bins.room), sum(map(bool, bins.items))
        bins.improve(sizes)
        assert sorted(i for b in bins.items for i in b) == sorted(order)
        assert all(100 - sum(sizes[i] for i in b) == room and room >= 0 for b, room in zip(bins.items, bins.room))
        after = sum((100 - x) ** 2 for x in bins.room), sum(map(bool, bins.items))
        assert after[0] >= before[0] and after[1] <= before[1]


BASE = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in BASE.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def random_token(r, alphabet, n):
    return "".join(r.choices(alphabet, k=n))


B62 = secrets.ENCODINGS["b62"][1]


def secret_rows():
    r = random.Random(11)
    rows = [(1, None), (2, ""), (3, "é🙂 password: 'abc' Token=\"s3cr3t-value\" apikey= x/y=z0 secret:"), (4, "AKIA" + "A1" * 8 + " AKIAAA " + "0" * 24 + "a f" * 30)]
    rows += [(5, "passwordpassword==abcdefg token token=abcdef"), (6, "xpasswd='" + "k" * 5000 + "' é AKIA" + "Z" * 200)]
    planted = {}
    for k in range(40):
        token = random_token(r, B62, r.choice([32, 40, 64]))
        text = f"Wörds before {token} and after"
        planted[100 + k] = (13, 13 + len(token))
        rows.append((100 + k, text))
    rows += [(200 + k, f"thetionheretionin{k} Internationalization2024Committee aaaaaaaaaaaaaaaaaaaaaaA1 abcdefghijklmnopqrstuvwxyzABCDEF0123 2024-01-02-the-Title-of-a-thing") for k in range(40)]
    return rows, planted


def test_secret_spans(spark):
    rows, planted = secret_rows()
    got = {x["doc_id"]: x for x in secrets.find(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    caught = 0
    for d, t in rows:
        want = [(s, o, e) for s, o, e, _ in base_spans(t or "")]
        assert [tuple(x) for x in got[d]["base"]] == want, d
        more = [tuple(x) for x in got[d]["spans"] if x["ord"] == 3]
        assert sorted(want + more) == [tuple(x) for x in got[d]["spans"]]
        if d in planted:
            caught += [(s, e) for s, _, e in more] == [planted[d]]
        elif 200 <= d:
            assert not more, t
    assert caught >= 36
    assert secrets.find(docs(spark, [])).count() == 0


def test_secrets_after_an_equals_sign(spark):
    value = "aB3dE5gH7jK9mN1pQ3sT5vW7xY2zR8uL4cF6"
    before = ["AUTH=", "AWS_SECRET_ACCESS_KEY=", "export AWS_ACCESS=", "https://host.org/a/b?x=1&sig=", "curl 'https://host.org/?sig=", "SIGNED=="]
    rows = [(k, f"{name}{value} after") for k, name in enumerate(before)]
    got = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in secrets.find(docs(spark, rows)).collect()}
    assert got == {k: [(len(name), 3, len(name) + len(value))] for k, name in enumerate(before)}
    assert {x["text"] for x in secrets.redact(docs(spark, rows)).collect()} == {f"{name}[SECRET] after" for name in before}


def test_random_tokens_of_one_case(spark):
    r = random.Random(13)
    rows, where, counts = [], {}, collections.Counter()
    for name in ("b32l", "b36", "B36"):
        for k in range(30):
            token = "7" + random_token(r, secrets.ENCODINGS[name][1], r.choice([31, 39, 63]))
            where[len(rows)] = name, (10, 3, 10 + len(token))
            rows.append((len(rows), f"key here: {token} after"))
    rows += [(500 + k, f"{'abcdefghij' * 3}{k} {'the0house0of0the0people0' * 3} AAAAAAAAAAAAAAAAAAAAAAAAAAAA7") for k in range(10)]
    for x in secrets.find(docs(spark, rows)).collect():
        if x["doc_id"] in where:
            name, span = where[x["doc_id"]]
            counts[name] += [tuple(s) for s in x["spans"]] == [span]
        else:
            assert not x["spans"]
    assert min(counts[n] for n in ("b32l", "b36", "B36")) >= 26, counts


def test_secrets_in_a_very_long_text(spark):
    r = random.Random(17)
    pieces = [f"é{k} {random_token(r, '0123456789abcdef', 24)} word " for k in range(20_000)]
    text = "".join(pieces)
    started = time.monotonic()
    frame = docs(spark, [(1, text), (2, "plain")])
    got = {x["doc_id"]: x for x in secrets.find(frame).collect()}
    assert [tuple(x) for x in got[1]["base"]] == [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert {x["doc_id"]: x["text"] for x in secrets.redact(frame).collect()} == {1: re.sub("[0-9a-f]{24,}", "[SECRET]", text), 2: "plain"}
    assert time.monotonic() - started < 120


def test_tests_are_given_for_known_secrets_too(spark):
    token = "aB3dE5gH7jK9mN1pQ3sT5vW7xY2zR8uL4cF6"
    got = secrets.find(docs(spark, [(1, f"password={token} and {token}9")])).collect()[0]
    assert [(x["start"], x["end"]) for x in got["tests"]] == [(9, 45), (50, 87)]
    assert [tuple(x) for x in got["spans"]] == [(0, 0, 45), (50, 3, 87)]


def test_lumps_of_middling_tokens_are_no_secrets(spark):
    """Tokens of which none is above one half are not evenly drawn; evenly spread ones are, but for the least."""
    rows = [("lump", k, 0.02 + 0.4 * k / 200) for k in range(200)] + [("even", k, (k + 0.5) / 200) for k in range(200)] + [("one", 0, 0.3)] * 50
    got = secrets.thresholds(spark.createDataFrame(rows, "stratum string, hash long, p double"), 0.05, 0.01)
    assert got["lump"] > 0.4
    assert got["even"] == 0.01
    assert got["one"] == 0.01


def test_redaction(spark):
    rows, planted = secret_rows()
    frame = docs(spark, rows)
    found = {x["doc_id"]: x["spans"] for x in secrets.find(frame).collect()}
    got = secrets.redact(frame)
    assert got.columns == frame.columns
    for x in got.collect():
        text = dict(rows)[x["doc_id"]]
        if text is None:
            assert x["text"] is None
            continue
        out, at = "", 0
        for s, _, e in map(tuple, found[x["doc_id"]]):
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert x["text"] == out + text[at:]
        assert x["spans"] == "s"


def test_normal_tail(spark):
    from pyspark.sql import functions as F

    zs = [0.0, 0.5, 1.0, -1.96, 3.0, 5.0, 40.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(secrets.tail(F.col("z"))).collect()
    for z, p in zip(zs, got):
        assert p[0] == pytest.approx(math.erfc(min(abs(z), 12) / 2**0.5), rel=2e-4, abs=1e-7)


def test_secret_query(spark, sf):
    texts = texts_of(spark, sf)
    for x in Q.op5_secret_scans(spark, sf).collect():
        want = base_spans(texts[x["doc_id"]])
        kinds = collections.Counter(k for *_, k in want)
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
        assert [z for z in x["spans"].split(",") if z and not z.startswith("random")] == [f"{k}:{s}:{e}" for s, _, e, k in want]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))


def test_pieces_of_random_texts():
    model, own = library(), piece_bpe.PieceModel(Q.tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(1)
    for k in range(4000):
        text = "".join(r.choices("ab theTHE  \n\t.,'é漢🙂▁<0x0A>ing\x00　", k=r.randint(0, 40)))
        found, decoded = own.encode(text)
        ids = [int(i) for i in found.split()]
        assert ids == model.encode(text), text
        assert decoded == own.decode([*ids, 2]) == model.decode([*ids, 2]), text


def test_texts_of_a_batch_together(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_SIZE", 40)
    model, own = library(), piece_bpe.PieceModel(Q.tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(3)
    looked_up, entry = [], own.entry
    monkeypatch.setattr(own, "entry", lambda part: looked_up.append(part) or entry(part))
    for size in (0, 1, 2, 300):
        texts = ["".join(r.choices("ab theTHE  \n\t.,'é漢🙂▁ing\x00　", k=r.choice([0, 1, 2, 30, 200]))) for _ in range(size)]
        looked_up.clear()
        found = [(bytes(ids), str(decoded, "utf-8"), n) for ids, decoded, n in own.encode_all([t.encode() for t in texts])]
        expected = [model.encode(t) for t in texts]
        assert found == [("".join(f"{i} " for i in ids).encode(), model.decode(ids), len(ids)) for ids in expected]
        assert len(looked_up) == len({*looked_up})


def test_prefix_table_equals_merging():
    own = piece_bpe.PieceModel(Q.tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(2)
    for _ in range(2000):
        part = "".join(r.choices("▁▁▁▁abethionrs'.", k=r.randint(1, 20)))
        assert own.tokens(part) == own.merge(part)


def test_pieces_query(spark, sf):
    model, texts = library(), texts_of(spark, sf)
    for x in Q.op7_sentencepiece_bpe(spark, sf).collect():
        ids = [*model.encode(texts[x["doc_id"]]), 2]
        assert x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_pieces_odd_rows(spark):
    model = library()
    got = piece_bpe.encoded(docs(spark, [x[:2] for x in ODD]), Q.tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == len(ODD)
    for x, (_, t, *_) in zip(sorted(got, key=lambda x: x["doc_id"]), ODD):
        assert [int(i) for i in x["ids"].split()] == [*model.encode(t or ""), 2]
    assert piece_bpe.encoded(docs(spark, []), Q.tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_suffix_automaton_phrases():
    r = random.Random(3)
    for _ in range(200):
        text, query = "".join(r.choices("abc ", k=60)), "".join(r.choices("abcd ", k=25))
        n = at = 0
        while at < len(query):
            k = 1
            while at + k < len(query) and query[at : at + k + 1] in text and query[at] in text:
                k += 1
            n, at = n + 1, at + k
        assert language_id.SuffixAutomaton(text).phrases(query) == n


def test_languages(spark, sf):
    got = Q.op8_language_id(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {x["doc_id"]: x for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(truth) and all(0 <= x["score"] <= 1 for x in rows)
    held = [x for x in rows if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in rows)
    assert sum(x["lang_pred"] == truth[x["doc_id"]]["lang"] for x in held) >= 0.95 * len(held)


def test_languages_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %% 34", "en"), (4, "the house of the people", "en"), (5, "das Haus und die Leute", "de"), (6, "x", None), (6, "x", None)]
    model = language_id.fit(docs(spark, rows))
    assert model.names == ("de", "en")
    frame = docs(spark, rows)
    with pytest.raises(ValueError):
        language_id.identify(spark, frame, model)  # `score` is there already
    got = {x["doc_id"]: x["l"] for x in language_id.identify(spark, frame, model, lang_as="l", score_as="s").collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("und", "und", "und", "en", "de")
    none = language_id.fit(docs(spark, []))
    assert [x["l"] for x in language_id.identify(spark, docs(spark, rows[3:4]), none, lang_as="l", score_as="s").collect()] == ["und"]
    with pytest.raises(ValueError):
        language_id.fit(docs(spark, rows), most_languages=1)


def brute_base(texts, train):
    counts = collections.Counter(w for d in train for w in texts[d].encode().lower().split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    return n, {d: (len(w := t.encode().lower().split()) + 1, sum(counts[x] > 0 for x in w) + 1, sum(log(counts[x]) for x in w) + log(len(train))) for d, t in texts.items()}


def test_class_model_query(spark, sf):
    texts = texts_of(spark, sf)
    train = {d for d in texts if zlib.crc32(str(d).encode()) % 10}
    n, want = brute_base(texts, train)
    rows = Q.op2_class_lm_scoring(spark, sf).collect()
    assert len(rows) == len(texts)
    for x in rows:
        tokens, known, base = want[x["doc_id"]]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (x["doc_id"] not in train, tokens, known, n)
        assert x["base_score"] == pytest.approx(base, rel=1e-9)
    held = [x for x in rows if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_class_model_by_hand(spark):
    """Small core and exchange vocabularies, so that most words take the joined way; the score is made again from the model."""
    r = random.Random(9)
    a, b = [f"aa{i}" for i in range(30)], [f"bb{i}" for i in range(30)]
    rows = [(k, " ".join(r.choice(side) for side in [a, b] * 20)) for k in range(60)] + [(70, None), (71, ""), (72, "unseen words aa1"), (73, "AA1 bb2"), (73, "AA1 bb2")]
    sizes = class_lm.Sizes(exchange_words=40, signatures=16, classes=6, core_words=20, rounds=6)
    model = class_lm.fit(docs(spark, rows[:60]), sizes)
    assert all(x < y for x, y in zip(model.likelihood, model.likelihood[1:])) and len(model.likelihood) > 1
    counts = {bytes(x["word"]): x["c"] for x in model.vocabulary.collect()}
    units = class_lm.Units([w for w, _ in model.core], sizes)
    # of the core, only the first exchange_words are units; here the core is the smaller one
    class_of = lambda w: int(model.class_of[units[w]])
    end = sizes.classes - 1
    transition, members = model.transition(), collections.Counter(class_of(w) for w in counts)
    mass = collections.Counter()
    for w, c in counts.items():
        mass[class_of(w)] += c
    mass[end], members[end] = 60, 1
    for x in class_lm.score(docs(spark, rows), model).collect():
        words = (dict(rows)[x["doc_id"]] or "").encode().lower().split()
        classes = [end, *map(class_of, words), end]
        want = sum(transition[p, q] for p, q in zip(classes, classes[1:]))
        for w, c in [*((w, counts.get(w, 0)) for w in words), (None, 60)]:
            k = end if w is None else class_of(w)
            want += math.log10((c + 0.1) / (mass[k] + 0.1 * (members[k] + 1)))
        assert x["score"] == pytest.approx(want, rel=1e-9)
    assert np.allclose((10**transition).sum(1), 1)


def test_exchange_gain_is_exact():
    r = np.random.default_rng(1)
    units, classes = 12, 4
    n = r.integers(0, 9, (units, units)).astype(float)
    of = np.arange(units) % (classes - 1)
    of[-1] = classes - 1

    def table(of):
        m = np.zeros((classes, classes))
        np.add.at(m, (np.repeat(of, units), np.tile(of, units)), n.ravel())
        return m

    value = lambda m: class_lm.xlogx(m).sum() - class_lm.xlogx(m.sum(1)).sum() - class_lm.xlogx(m.sum(0)).sum()
    right = np.stack([np.bincount(of, weights=n[u], minlength=classes) for u in range(units)])
    left = np.stack([np.bincount(of, weights=n[:, u], minlength=classes) for u in range(units)])
    best, gain = class_lm.best_classes(left[:-1], right[:-1], np.diag(n)[:-1], of[:-1], table(of))
    for u in range(units - 1):
        scores = []
        for c in range(classes - 1):
            trial = of.copy()
            trial[u] = c
            scores.append(value(table(trial)) - value(table(of)))
        assert gain[u] == pytest.approx(max(scores), abs=1e-6)
        assert scores[best[u]] == pytest.approx(max(scores), abs=1e-6)


def test_class_model_without_training(spark):
    model = class_lm.fit(docs(spark, []), class_lm.Sizes(exchange_words=8, signatures=4, classes=3, core_words=8))
    got = class_lm.score(docs(spark, [(1, "a b"), (2, None)]), model).collect()
    assert [(x["n_tokens"], x["n_known"]) for x in sorted(got, key=lambda x: x["doc_id"])] == [(3, 0), (1, 0)]
    assert all(math.isfinite(x["score"]) and math.isfinite(x["base_score"]) for x in got)
    assert class_lm.score(docs(spark, []), model).count() == 0


def lz_phrases(data):
    seen, cur = set(), b""
    for k in range(len(data)):
        cur += data[k : k + 1]
        if cur not in seen:
            seen.add(cur)
            cur = b""
    return seen


def test_phrases_are_those_of_lz78():
    r = random.Random(4)
    for _ in range(200):
        data = bytes(r.choices(b"abcd", k=r.randint(0, 300)))
        seen = set()
        rest = lz_fingerprint.parse(data, seen)
        assert len(seen) == len(lz_phrases(data))
        cut = r.randint(0, len(data))
        parts = set()
        assert lz_fingerprint.parse(data[cut:], parts, lz_fingerprint.parse(data[:cut], parts)) == rest and parts == seen


def test_splices(spark):
    r = random.Random(6)
    rows = [(d, "".join(r.choices("abé 🙂\n", k=r.choice([0, 1, 2, 50, 400])))) for d in r.sample(range(-1000, 10**9), 40)] + [(10**12, None), (3, "same"), (2, "same")]
    got = {x["doc_id"]: x for x in lz_fingerprint.splice_comparison(docs(spark, rows)).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert set(got) == {d for d, _ in order}
    fp = lambda t: lz_fingerprint.fingerprint(t.encode())
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        x = got[d]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x["fingerprint"], x["edited_fingerprint"]) == (lz_fingerprint.text_of(fp(t)), lz_fingerprint.text_of(fp(edited)))
        assert x["near_edited"] == lz_fingerprint.likeness(fp(t), fp(edited)) and x["near_next"] == lz_fingerprint.likeness(fp(t), fp(after))
    assert lz_fingerprint.splice_comparison(docs(spark, [])).count() == 0
    assert [x["near_next"] for x in lz_fingerprint.splice_comparison(docs(spark, [(1, "alone")])).collect()] == [1.0]
    assert lz_fingerprint.fingerprints(docs(spark, rows)).count() == len(rows)


def check_splices(rows, got):
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (-x[0], x[1].encode()))
    fp = [lz_fingerprint.fingerprint(t.encode()) for _, t in order]
    want = collections.Counter()
    for k, (d, t) in enumerate(order):
        n = (k + 1) % len(order)
        edited = t[: len(t) - len(t) // 2] + order[n][1][: len(t) // 2]
        other = lz_fingerprint.fingerprint(edited.encode())
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.text_of(fp[k]), lz_fingerprint.text_of(other), lz_fingerprint.likeness(fp[k], other), lz_fingerprint.likeness(fp[k], fp[n])] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_splices_over_several_partitions(spark):
    r = random.Random(12)
    rows = [(r.randrange(100), "".join(r.choices("abé ", k=r.choice([0, 1, 5, 80])))) for _ in range(60)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        check_splices(rows, lz_fingerprint.splice_comparison(docs(spark, rows)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_likeness_follows_shared_text():
    r = random.Random(8)
    words = [f"{random_token(r, 'aeioulnrst', 5)}" for _ in range(500)]
    a = " ".join(r.choices(words, k=600)).encode()
    near, far = a[:-60] + b"something else at the end", " ".join(r.choices(words, k=600)).encode()
    fp = lz_fingerprint.fingerprint
    assert lz_fingerprint.likeness(fp(a), fp(near)) > 0.7 > 0.6 > lz_fingerprint.likeness(fp(a), fp(far))


def test_splice_query(spark, sf):
    got = Q.op9_lz_fingerprints(spark, sf)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    check_splices(list(texts_of(spark, sf).items()), got.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_ranges_of_clustered_keys(spark, parts):
    r = random.Random(2)
    keys = [r.randrange(10**6) for _ in range(300)] + [10**15 + k for k in range(300)] + [-(2**40)] + [7] * 50
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k long").repartition(parts)
    firsts = first_keys(rows, "k", 20)
    ordered, want = sorted(keys), []
    for at, k in enumerate(ordered):
        if at == 0 or k != ordered[at - 1]:
            want.append((at // 20, k))
    assert firsts.tolist() == [k for n, (q, k) in enumerate(want) if n == 0 or want[n - 1][0] != q]
    got = {x["k"]: x["r"] for x in rows.select("k", range_of(F.col("k"), firsts).alias("r")).collect()}
    assert got == {k: 0 if k is None else sum(f <= k for f in firsts) - 1 for k in [*keys, None]}
    assert len(first_keys(rows.where("false"), "k", 20)) == 0
