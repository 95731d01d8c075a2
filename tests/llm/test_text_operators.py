"""Operators on single texts: repetition, tokenizers, personal data."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import op1_repetition, op4_bpe, op5_pii, op7_token_counts
from fieldloom.llm.bpe import Encoder
from fieldloom.llm.common import tokenizer_path, vocabulary
from fieldloom.llm.pretokens import ByteLevel, Library, Pieces, pretokens

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (2, " \n\t"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "the " * 30000), (6, "é" * 5000 + " 日本 😀")]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, 7, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int, kept string")


# Repetition


def brute_repeats(words, least):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)

    def cover(at_least, size=None):
        return len({p for i, b in enumerate(best) if b >= at_least for p in range(i, i + (size or b))})

    return cover(3, 3), cover(least), max(best, default=0)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=22), max_size=5))
@settings(max_examples=150, deadline=None)
def test_suffix_array_against_brute_force(texts):
    got = op1_repetition.measure([" ".join(t) for t in texts], 4)
    assert [g[4:] for g in got] == [brute_repeats(t, 4) for t in texts]


def test_base_measures():
    text = "#a b\n\n x \n#a b\n \nx\u2003y|\n x "
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    got = op1_repetition.measure([text])[0]
    assert got[:4] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)))


def test_repetition_verdicts(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, huge = fresh(60), fresh(160)
    texts = {1: fresh(500), 2: " ".join([passage, fresh(400), passage]), 3: " ".join([huge, fresh(1500), huge]), 4: fresh(49), 5: " ".join([fresh(20)] * 10), 6: " ".join([passage] * 2 + [fresh(150)] + [passage])}
    got = {r.doc_id: (r.base_failed, r.kept) for r in op1_repetition.quality(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, False), 4: (True, False), 5: (True, False), 6: (True, False)}


def test_repetition_edge_cases(spark):
    got = op1_repetition.quality(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got)
    assert {r.n_words for r in got if r.doc_id == 5} == {30000}
    kept = op1_repetition.keep_good(odd(spark).withColumn("_repetition", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "N_TOKENS", "kept", "_repetition"] and kept.count() == 0
    assert op1_repetition.quality(odd(spark).limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def pair():
    return Encoder(PATH), tokenizers.Tokenizer.from_file(PATH)


ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'ll", "9", "<|endoftext|>", "!", "\x1c", "\xa0", "\u2003", "日本", "😀", "the", " of", "\x85", "½"]


@given(st.lists(st.sampled_from(ALPHABET), max_size=30))
@settings(max_examples=600, deadline=None)
def test_bpe_agrees_with_the_library(pair, parts):
    own, library = pair
    text = "".join(parts)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert list(own.count_each([text])) == [len(ids)]


@given(st.lists(st.integers(0, 50256), max_size=40))
@settings(max_examples=200, deadline=None)
def test_decoding_any_ids(pair, ids):
    own, library = pair
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_and_full_cache(pair):
    own, library = pair
    rng = random.Random(2)
    small = Encoder(PATH)
    small.kept = 40
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 90))) for _ in range(20)) for _ in range(4)]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [[i for ids in row for i in ids] for row in small.encode_each(texts)] == want
        assert list(small.count_each(texts)) == [len(w) for w in want]
    assert own.encode("ab" * 20000) == library.encode("ab" * 20000, add_special_tokens=False).ids


def test_round_trip_query(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    got = op4_bpe.round_trip(odd(spark), PATH).collect()
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    ids = odd(spark).select(op4_bpe.encode(F.col("text"), PATH).alias("ids"), "text")
    assert all(r.back == (r.text or "") for r in ids.select(op4_bpe.decode(F.col("ids"), PATH).alias("back"), "text").collect())
    assert op4_bpe.round_trip(odd(spark).limit(0), PATH).count() == 0


# Token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_agree_with_libraries(spark, name):
    path = tokenizer_path(name)
    if name.endswith("json"):
        library = tokenizers.Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    rows = [r for r in ODD if r[0] != 5] if name.endswith("model") else ODD
    got = op7_token_counts.token_counts(odd(spark).where("doc_id is null or doc_id <> 5") if name.endswith("model") else odd(spark), path).collect()
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


PIECE_ALPHABET = [*ALPHABET, "▁", "▁▁", "<s>", "</s>", "<|startoftext|>", "É", "   ", "\x00"]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", ByteLevel), ("word_bpe_49k.json", Library), ("piece_bpe_32k.model", Pieces)])
def test_tokens_are_the_sum_over_pretokens(name, kind):
    of = vocabulary(tokenizer_path(name))
    own = pretokens(of)
    assert type(own) is kind
    if name.endswith("json"):
        library = tokenizers.Tokenizer.from_file(tokenizer_path(name))
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        count = lambda t: len(own.model.encode(t))
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECE_ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", " ", "x" * 3000 + " y" * 500]
    f = own.split(texts)
    total = f.other.copy()
    for text, word, freq in zip(f.text, own.lengths(f.words)[f.word] if len(f.words) else [], f.freq, strict=True):
        total[text] += word * freq
    assert total.tolist() == [count(t) for t in texts]
    assert len(set(f.words)) == len(f.words) and len(set(zip(f.text.tolist(), f.word.tolist(), strict=True))) == len(f.word)


def test_counts_over_many_blocks(spark, monkeypatch):
    """Small blocks, few hot words and a full cache give the same counts."""
    library = tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(8)
    words = [f"{rng.choice(['the', 'Über', 'x9', '日本'])}{i % 97}," for i in range(400)]
    rows = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(1, "hot " * 500)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(repr((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))) for i, t in rows)
    for block, hot, kept in ((7, 3, 10), (2000, 24, 200_000), (1, 1, 0)):
        monkeypatch.setattr(op7_token_counts, "BLOCK_DOCS", block)
        monkeypatch.setattr(op7_token_counts, "HOT", hot)
        monkeypatch.setattr(op7_token_counts, "KEPT", kept)
        got = op7_token_counts.token_counts(docs, PATH).drop("over_limit").collect()
        assert sorted(repr(tuple(r)) for r in got) == want


# Personal data

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in re.finditer(EMAIL, t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(CARD, t) if 14 <= len(digits(m[0])) <= 19 and op5_pii.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(PHONE, t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], op5_pii.KINDS.index(s[2])))


@given(st.lists(st.sampled_from(["a", "@", ".", "1", "23", "é", "-", " ", "_", "+", "(", ")", "4", "x.y", "@b.c", "255", "0", "4111111111111111"]), max_size=25))
@settings(max_examples=1500, deadline=None)
def test_base_spans_against_plain_patterns(parts):
    text = "".join(parts)
    assert op5_pii.base_spans(text)[0] == brute_spans(text)


def test_patterns_stay_linear():
    for text in ("1" * 200_000, "a@" * 60_000, "1." * 100_000, "+1(" * 60_000, "ab." * 100_000 + "@", "1234-" * 60_000):
        op5_pii.find(text)


def test_detection(spark):
    good = "mail a.b@x.org or 10.0.0.1 card 4111111111111111 call +1 (811) 555-3281 now"
    swallowed = "Ring +1 (389) 555-5010 4652511922028856 soon"  # the base takes both numbers for one phone and drops it
    bad = "order 4111111111111112 and version 1.2.3"
    rows = [(i, good) for i in range(300)] + [(1000, swallowed), (1001, bad), (1002, None), (1003, ""), (None, good)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in op5_pii.detect(docs).collect()}
    assert [got[0][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [1, 1, 1, 1]
    want = op5_pii.spans_text(brute_spans(good))
    assert got[0].spans == want == got[None].spans and got[0].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[1000].n_phone == 0 and "phone:5:22" in got[1000].spans
    assert got[1001].spans == got[1002].spans == got[1003].spans == ""
    assert op5_pii.detect(docs.limit(0)).count() == 0


def test_em_finds_the_reliable_labelers():
    rng = random.Random(5)
    counts, truth = {}, {}
    for _ in range(20000):
        real = rng.random() < 0.5
        v = [1 if rng.random() < (0.9 if real else 0.2) else 0, 1, (1 if rng.random() < 0.95 else -1) if real else (1 if rng.random() < 0.1 else -1), 1 if rng.random() < (0.8 if real else 0.3) else 0, 0, 0]
        code = op5_pii._code("card", v, real and rng.random() < 0.3)
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(real)
    model = op5_pii.Reliabilities(counts)
    card = op5_pii.KINDS.index("card")
    right = sum(sum(r == (model.posterior[c] > 0.5) for r in rs) for c, rs in truth.items())
    assert right / 20000 > 0.9
    assert model.given_real[card][2][2] > 0.85 and model.given_not[card][0][2] > 0.8
    assert all(p == 1.0 for c, p in model.posterior.items() if op5_pii._decode(c)[1])  # the base is given to the end
    unseen = op5_pii.KINDS.index("iban")  # a kind without candidates keeps its beliefs
    assert model.prior[unseen] == 0.5 and model.given_real[unseen][2][0] == pytest.approx(0.6)


def planted(rng, n):
    """Texts with spans that belong to a person or are secret beside spans that look like them: (text, real spans beyond the base)."""
    from fieldloom.llm.op5_pii import luhn

    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    fill = lambda: " ".join(rng.choice(["lorem", "the", "ipsum", "of", "dolor", "7", "and", "2024"]) for _ in range(rng.randint(3, 12)))

    def card(valid):
        while True:
            d = rng.choice(["4", "51", "34"]) + digits(rng.choice([14, 13]))
            if luhn(d) == valid and len(d) >= 14:
                return d

    def iban():
        body = digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check:02d}{body}"

    real = {
        "phone": lambda: (rng.choice(["call ", "Tel: ", "phone "]), f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", " now"),
        "iban": lambda: ("bank account ", iban(), "."),
        "ssn": lambda: ("ssn ", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", " "),
        "secret": lambda: (rng.choice(['token = "', "api_key: ", "password=", "secret_key = "]), rng.choice([hexa(40), hexa(32), "ghp_" + hexa(36), "AKIA" + digits(8) + "QWERTYUI"]), '"'),
        "email": lambda: ("mail ", f"ann.{hexa(4)} (at) site.org", " or"),
    }
    false = [
        lambda: "order " + card(False), lambda: f"version {rng.randint(1, 9)}.{rng.randint(300, 999)}.1.2", lambda: "isbn 978-3-16-148410-0", lambda: "password: changeme",
        lambda: "token: something", lambda: "DE00" + digits(18), lambda: f"section {digits(3)}-{digits(2)}", lambda: "secret = none", lambda: f"#{hexa(6)}", lambda: "invoice " + card(False),
    ]
    base = [lambda: "write to ann@site.org", lambda: f"host 10.0.{rng.randint(0, 255)}.7", lambda: "card " + card(True), lambda: f"call +1 (555) {rng.randint(200, 999)}-{digits(4)}"]
    out = []
    for _ in range(n):
        text, spans = fill(), []
        for _ in range(rng.randint(0, 4)):
            text += " "
            what = rng.random()
            if what < 0.4:
                kind = rng.choice(sorted(real))
                before, span, after = real[kind]()
                spans.append(f"{kind}:{len(text + before)}:{len(text + before + span)}")
                text += before + span + after
            else:
                text += rng.choice(false if what < 0.7 else base)()
            text += " " + fill()
        out.append((text, spans))
    return out


def added(spark, texts):
    rows = op5_pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: set(r.spans.split(",")) - {op5_pii.spans_text([s]) for s in brute_spans(texts[r.doc_id])} - {""} for r in rows}


@pytest.mark.parametrize(("seed", "n"), [(1, 2500), (2, 60)])
def test_added_spans_on_planted_texts(spark, seed, n):
    """Precision and recall of what the method adds to the base, in a large and in a small corpus; and no failing card."""
    made = planted(random.Random(seed), n)
    texts = [t for t, _ in made]
    got = added(spark, texts)
    want = {i: set(s) for i, (_, s) in enumerate(made)}
    hits = sum(len(got[i] & want[i]) for i in want)
    precision, recall = hits / max(1, sum(map(len, got.values()))), hits / max(1, sum(map(len, want.values())))
    assert precision >= 0.95 and recall >= 0.9, (precision, recall)
    for i, spans in got.items():
        for s in spans:
            kind, a, b = s.split(":")
            assert kind != "card" or op5_pii.luhn(re.sub("[^0-9]", "", texts[i][int(a) : int(b)]))


def test_detection_of_a_very_long_text(spark):
    text = "call (555) 777-1234 or token = \"" + "0a1b2c3d" * 5 + "\" " + "word 12 " * 200_000 + "ann@site.org"
    rows = [(1, text, 5), (2, text, 5), (2, None, 5)]
    got = op5_pii.detect(spark.createDataFrame(rows, "doc_id long, text string, N_Spans int")).collect()
    assert sorted((r.doc_id, r.n_email, r.n_secret, r.n_spans) for r in got) == [(1, 1, 1, 3), (2, 0, 0, 0), (2, 1, 1, 3)]
