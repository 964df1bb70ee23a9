"""Each corpus operator against a brute-force version on a small, awkward fixture."""

import hashlib
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from flightlake.llm import bpe, exact_dedup, fingerprints, lang_id, line_dedup, packing, pii, simhash, toxicity, warc

LINE = "this line stands in a good many documents, word for word"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven grey geese look on from the far river bank " * 12
TEXTS = [
    None, "", "", " \t\n", "a", "A", "a b", "one two", "one  two", "ONE two", "é", "é", "ﬁn", "fin",
    *[f"head {i}\n  {LINE.upper() if i % 2 else LINE}\t\nmid\n{LINE}\ntail" for i in range(7)],
    "same text here", "same text here", "same  text\nhere", LONG, BASE, BASE + "end", BASE.replace("geese", "birds", 1), "x" * 5000, "\n\n\n", "日本語 テキスト", "🙂 <|endoftext|> it's",
    "mail a.b@c.example.org, ip 10.0.0.255 and 1.2.3.256, card 4111 1111 1111 1111, +49 (30) 1234-5678",
]
ROWS = [(10 * i, t, "en" if i % 3 else "de", "src", len(t or ""), "x", 1, "k") for i, t in enumerate(TEXTS)]
#: Extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, fp long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    return spark.createDataFrame([(None, "nothing", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), *ROWS[:8], ROWS[5], ROWS[5]], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_line_dedup_matches_brute_force(docs):
    strip = lambda s: s.strip(" \t\n\x0b\x0c\r")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    lines = {i: (t or "").split("\n") for i, t, *_ in ROWS}
    holders = {}
    for i, own in lines.items():
        for x in own:
            if len(k := lower(strip(x))) >= 40:
                holders.setdefault(k, set()).add(i)
    got = by_id(line_dedup.dedup_lines(docs))
    assert len(got) == len(ROWS)
    for i, own in lines.items():
        kept = [x for x in own if len(h := holders.get(lower(strip(x)), ())) < 5 or i == max(h)]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (len(own), len(own) - len(kept), "\n".join(kept))
        runs = [x for r in got[i]["keep_bitmap"] for x in own[r["start"] : r["start"] + r["length"]]]
        assert runs == kept


def test_line_dedup_edges(none, odd, spark):
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    rows = spark.createDataFrame([(None, LINE)] + [(1, LINE)] * 2 + [(i, LINE) for i in range(2, 6)], "doc_id long, text string")
    kept = [(r["doc_id"], r["kept_text"] == LINE) for r in line_dedup.dedup_lines(rows).collect()]
    assert Counter(kept) == Counter([(None, False), (1, False), (1, False), (2, False), (3, False), (4, False), (5, True)])


def test_language_prediction(spark, none, odd):
    words = {"en": "the and that with from over many words", "de": "der und das nicht über viele wörter sind"}
    rows = [(i, " ".join(words[g].split()[(i + k) % 8] for k in range(12)), g) for i in range(160) for g in [("en", "de")[i % 2]]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !!", "de"), (902, "", None)], "doc_id long, text string, lang string")
    got = by_id(lang_id.identify(df))
    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert lang_id.identify(none).count() == 0
    assert lang_id.identify(odd).count() == odd.count()
    assert set(by_id(lang_id.keep_known(df))) == {i for i, *_ in rows}


def test_letters_alone_make_a_language(spark):
    assert [lang_id.words_only(t) for t in ("½ ² ³ Ⅷ", "٣ ५ 3", "\u0301", "x²y", "I½ Ⅷa", "nai\u0308ve", "ΑΒ—γ", "ß_1ª")] == ["", "", "", "x y", "i a", "nai\u0308ve", "αβ γ", "ß ª"]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("das und der", "de"), ("the and that", "en")] * 20 + [("½ ² ³ Ⅷ", "de"), ("\u0301\u0301", "en")])], "doc_id long, text string, lang string")
    got = by_id(lang_id.identify(docs))
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (40, 41)] == [("und", 0.0)] * 2 and {r["lang_pred"] for i, r in got.items() if i < 40} == {"de", "en"}


def test_language_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "BATCH_CHARS", 40)
    texts = [f"{w} {w[::-1]} ünd {i}" * (1 + i % 3) for i, w in enumerate(["river", "stone", "fluss", "stein", "licht", "paper"] * 6)] + ["q" * 3000]
    rows = [(i, t, ("en", "de", None)[i % 3], "x", 1.0) for i, t in enumerate(texts)] + [(500, texts[0], "en", "x", 1.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, scores double").repartition(3)
    e = lang_id.Encoder()

    def vector(text):
        plain, out = f" {lang_id.words_only(text)} ", np.zeros(e.dimensions)
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            out += np.roll(e.letter(ord(a)), 2) * np.roll(e.letter(ord(b)), 1) * e.letter(ord(c)).astype(int)
        return out / np.linalg.norm(out)

    sums = {}
    for i, t, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vector(t)
    for r in lang_id.identify(docs).collect():
        own = vector({i: t for i, t, *_ in rows}[r["doc_id"]])
        cosines = {k: max(0.0, float(own @ v / np.linalg.norm(v))) for k, v in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r["score"] == pytest.approx(cosines[best], abs=1e-4)
        assert cosines[r["lang_pred"]] == pytest.approx(cosines[best], abs=1e-4)


def test_ties_go_to_the_language_that_sorts_first(spark):
    docs = spark.createDataFrame([(i, "same words here", ("xx", "aa")[i % 2]) for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in lang_id.identify(docs).collect()} == {"aa"}


def test_language_stage_without_a_language(spark, none):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (None, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in lang_id.keep_known(docs).collect()] == [1]
    assert lang_id.keep_known(none).count() == 0 and lang_id.keep_known(none).columns == none.columns


def test_short_documents_stay(spark):
    words = {"en": "the and that with from over many words", "de": "der und das nicht über viele wörter sind"}
    rows = [(i, " ".join(words[g].split()[(i + k) % 8] for k in range(12)), g) for i in range(160) for g in [("en", "de")[i % 2]]]
    short = ["A.", "A.\nAll rights reserved.", "Avec.", "by", "Fjord", "Fjord " * 500, "zephyr quiz", "日本語"]
    foreign = "".join(chr(0x4E00 + 37 * k) for k in range(400))
    rows += [(1000 + i, t, None) for i, t in enumerate(short)] + [(2000, foreign, None), (2001, "12 !!", None), (2002, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scores = {i: r["score"] for i, r in by_id(lang_id.identify(df)).items()}
    least = lang_id.judged(df, "found")[1]
    assert min(scores[1000 + i] for i in range(len(short))) < 0.06 and scores[2000] < least
    assert set(by_id(lang_id.keep_known(df))) == {i for i, *_ in rows} - {2000, 2001, 2002}


def test_language_vectors_match_definition():
    e, text = lang_id.Encoder(64), "Abcab, abc"
    plain = " abcab abc "
    want = np.zeros(64)
    for a, b, c in zip(plain, plain[1:], plain[2:]):
        want += np.roll(e.letter(ord(a)), 2) * np.roll(e.letter(ord(b)), 1) * e.letter(ord(c)).astype(int)
    got = e.vectors([text, "", "other words"])
    np.testing.assert_allclose(got[0], want / np.linalg.norm(want), atol=1e-5)
    assert not got[1].any()


def python_canonical(text):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(fold.split())


def test_fingerprints_match_brute_force(docs):
    got = by_id(fingerprints.fingerprint_documents(docs))
    texts = [t or "" for t in TEXTS]
    canon, names = [python_canonical(t) for t in texts], {}
    for i, t in enumerate(texts):
        r, nxt = got[10 * i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == sha(edit), i
        assert r["near_next"] == float(canon[i] == python_canonical(nxt))
        assert r["near_edited"] == float(canon[i] == python_canonical(edit)) == float(r["fingerprint"] == r["edited_fingerprint"])
        for c, f in ((canon[i], r["fingerprint"]), (python_canonical(edit), r["edited_fingerprint"])):
            assert names.setdefault(c, f) == f
    assert len(set(names.values())) == len(names)


def test_fingerprints_tell_colliding_forms_apart(docs):
    from pyspark.sql import functions as F

    weak = by_id(fingerprints.fingerprint_documents(docs, hashed=lambda c: F.length(c).cast("string")))
    canon = {i: python_canonical(t or "") for i, t, *_ in ROWS}
    for i in canon:
        for j in canon:
            assert (weak[i]["fingerprint"] == weak[j]["fingerprint"]) == (canon[i] == canon[j]), (i, j)


def test_fingerprint_edges(none, odd, spark):
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert fingerprints.fingerprint_documents(odd).count() == odd.count()
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == sha("abab")


def test_next_document_crosses_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LEAST_BUCKET", 40)
    monkeypatch.setattr(fingerprints, "MOST_BUCKET", 40)
    for most in (4096, 16):  # more quantiles than a step looks up, and quantiles that are cut further
        monkeypatch.setattr(fingerprints, "QUANTILES", most)
        ids = [i * i * 7 - 50 for i in range(700)]
        df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: r["next_doc_id"] for r in fingerprints.with_next(df, lambda body: []).collect()}
        ids = sorted(ids)
        assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_next_document_of_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LEAST_BUCKET", 100)
    monkeypatch.setattr(fingerprints, "MOST_BUCKET", 100)
    rows = [(i, f"text {i}") for i in range(0, 90, 3)] + [(31, f"hot {k}") for k in range(300)] + [(None, f"none {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = fingerprints.with_next(df, lambda body: [])
    own = hashed.select("doc_id", "body", "text_hash", "next_doc_id", "next_body").collect()
    ordered = sorted(own, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_hash"]))
    assert len(own) == len(rows)
    assert [(r["next_doc_id"], r["next_body"]) for r in ordered] == [(r["doc_id"], r["body"]) for r in ordered[1:] + ordered[:1]]
    bucket, edges = fingerprints._buckets(hashed.select("doc_id", "body", "text_hash"))
    sizes = hashed.groupBy(bucket.alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 60 and edges.count() == len(sizes)


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_packing_round_trip(docs, none, odd):
    from tokenizers import Tokenizer

    t, pieces, bins = Tokenizer.from_file(PATH), {}, {}
    for r in packing.pack(docs, PATH).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for i, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(pieces.pop(i), key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert not pieces
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(none, PATH).count() == 0
    assert packing.pack(odd, PATH).count() == odd.count()


def test_packing_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_ITEMS", 8)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = np.random.default_rng(8)
    for sizes in (rng.integers(1, 1500, 300), np.full(120, 1100), np.r_[np.full(100, 1200), np.full(30, 700)], rng.integers(1, 60, 400)):
        docs = spark.createDataFrame([(i, "the " * (int(n) - 1)) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(4)
        rows = packing.pack(docs, PATH).collect()
        assert sorted((r["doc_id"], r["length"]) for r in rows) == [(i, int(n)) for i, n in enumerate(sizes)]
        used = Counter()
        for r in rows:
            used[r["sequence_id"]] += r["length"]
        first, second = [*sorted(used.values()), 2048][:2]
        assert max(used.values()) <= 2048 and (len(used) == 1 or first + second > 2048 - 300)
        assert len(used) <= 1.15 * max(-(-int(sizes.sum()) // 2048) + 2, (sizes > 1024).sum())  # eight items at a time


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_word_encoder_matches_library(text):
    e = packing._encoder(PATH)
    assert e.encode(text) == e.whole(text)


def test_word_encoder_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_RUNS", 30)
    e = packing.WordEncoder(PATH)
    texts = [f"word{i} the quick, brown fox{i % 9}! {'y' * 70} item{i % 40}" for i in range(200)]
    assert [e.encode(t) for t in texts + texts] == [e.whole(t) for t in texts + texts]
    assert e.older and len(e) < 80


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_bins(lengths):
    bins = packing.best_fit(lengths, 20)
    # The same by definition: longest first, each into the fullest bin that takes it.
    plain: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        fitting = [b for b in plain if sum(b) + n <= 20]
        if fitting:
            max(fitting, key=sum).append(n)
        else:
            plain.append([n])
    assert sorted(sorted(lengths[i] for i in b) for b in bins) == sorted(map(sorted, plain)) or sorted(sum(lengths[i] for i in b) for b in bins) == sorted(map(sum, plain))
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    used = [sum(lengths[i] for i in b) for b in bins]
    assert all(u <= 20 for u in used)
    assert all(a + b > 20 for k, a in enumerate(used) for b in used[:k])


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids, comp = sorted(fps), {i: i for i in fps}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[a] > comp[b]:
                    comp[a], again = comp[b], True
    return comp


def test_simhash_matches_brute_force(docs, none, odd):
    got = by_id(simhash.near_components(docs))
    fps = {i: plain_fingerprint(t or "") for i, t, *_ in ROWS}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)
    assert simhash.near_components(none).count() == 0
    assert simhash.near_components(odd).count() == odd.count()


def chain_of_texts():
    """Three texts of which only the second is within 3 bits of the others."""
    words = BASE.split()
    texts = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in range(0, len(words), 2)]
    fps = {t: plain_fingerprint(t) for t in texts}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
    return next((a, b, c) for b in texts for a in texts for c in texts if near(a, b) and near(b, c) and not near(a, c))


def test_simhash_links_rows_without_an_id(spark):
    a, b, c = chain_of_texts()
    rows = [(5, a), (None, b), (9, c), (None, "alone without any id"), (7, "far from the others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_components(docs).collect()}
    assert got == {(i, f"{plain_fingerprint(t):016x}"): {a: 5, b: 5, c: 5}.get(t, i) for i, t in rows}


def test_keep_one_judges_texts_of_one_id_apart(spark):
    a, b, c = chain_of_texts()
    rows = [(3, a), (5, b), (5, "unrelated words under the id five"), (3, "more unrelated words, id three"), (None, c), (None, "alone"), (None, "alone"), (8, "x y z"), (8, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], rows[5], rows[7]], key=str)


def test_simhash_links_are_complete_in_hot_blocks(spark):
    rng = np.random.default_rng(7)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in fps.items()], "fp long, node long")
    want = brute_components(fps)
    from flightlake.llm.components import components

    for hot in (25, 4096):
        links = simhash.links(df, hot_block=hot)
        assert all((fps[r["src"]] ^ fps[r["dst"]]).bit_count() >= 1 for r in links.collect())
        got = {r["node"]: r["component"] for r in components(links).collect()}
        assert {i: got.get(i, i) for i in fps} == want, hot


def test_components_of_a_chain(spark):
    from flightlake.llm.components import components

    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_pii_base_spans():
    text = TEXTS[-1]
    found = {k: [text[a:b] for kind, a, b in pii.base_spans(text) if kind == k] for k in pii.BASE_KINDS}
    assert found == {"email": ["a.b@c.example.org"], "ip": ["10.0.0.255"], "card": ["4111 1111 1111 1111"], "phone": ["+49 (30) 1234-5678"]}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+_% 0149()é", max_size=50))
def test_pii_base_spans_match_plain_patterns(text):
    import re

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    want = []
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            want += [(kind, *m.span())] if ok else []
    assert pii.base_spans(text) == want


def test_pii_added_kinds_and_redaction(docs, none, odd):
    text = "IBAN: DE89 3704 0044 0532 0130 00, bad DE89 3704 0044 0532 0130 01; ssn 123-45-6789; token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""
    spans = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b, _ in spans if k in pii.ADDED_KINDS] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert "DE89 3704 0044 0532 0130 00" not in pii.redact(text, spans)
    assert pii.query(none).count() == 0 and pii.query(odd).count() == odd.count()
    out = by_id(pii.redact_documents(docs))
    assert len(out) == len(ROWS) and out[0]["text"] is None and out[10 * (len(ROWS) - 1)]["text"].startswith("mail <EMAIL>, ip <IP>")
    assert pii.redact_documents(docs).columns == docs.columns
    assert pii.redact_documents(none).count() == 0 and sorted(r["n_chars"] for r in pii.redact_documents(odd).collect() if r["text"]) == sorted(len(r["text"]) for r in pii.redact_documents(odd).collect() if r["text"])


def test_pii_iban_with_a_card_inside_stays_whole():
    text = "pay GB19NWBK00925430999126 now, card 4111 1111 1111 1111"
    spans = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b, _ in spans] == [("card", "00925430999126"), ("card", "4111 1111 1111 1111"), ("iban", "GB19NWBK00925430999126")]
    assert pii.redact(text, spans) == "pay <IBAN> now, card <CARD>"
    text = "token a.long-local-part-of-an-address-12@example.org"
    assert [k for k, *_ in pii.find_spans(text)] == ["email"]


def test_pii_context_on_both_sides_scores_every_kind():
    assert [s[0] for s in pii.find_spans("123-45-6789 (SSN)")] == ["ssn"] and not pii.find_spans("part 123-45-6789 (steel)")
    cases = {"email": ("a@b.org", "mail"), "ip": ("10.0.0.255", "the IP"), "card": ("4111 1111 1111 1111", "credit card"), "phone": ("+49 (30) 1234-5678", "phone")}
    for kind, (value, word) in cases.items():
        score = lambda text: next(s for k, _, _, s in pii.find_spans(text) if k == kind)
        alone = score(f"see {value}.")
        assert pii.MIN_SCORE <= alone < score(f"{word}: {value}.") == score(f"{value} ({word})") <= 1
        assert score(f"{word} {'x ' * 30}{value}") == alone


def test_pii_query_matches_brute_force(docs):
    """The query's columns from ``find_spans`` by hand, and its base part from the plain patterns' spans."""
    got = by_id(pii.query(docs))
    for i, t, *_ in ROWS:
        spans = pii.find_spans(t or "")
        joined = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in xs)
        base = pii.base_spans(t or "")
        assert got[i]["base_sha256"] == sha(joined(base)) and got[i]["spans"] == joined(spans) and joined(spans).startswith(joined(base))
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in base) for k in pii.BASE_KINDS]
        assert got[i]["scores"] == [s for *_, s in spans]


def test_exact_dedup_matches_brute_force(docs, none, odd):
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault((t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1], sha(body)) for body, g in groups.items() for _, i in g}
    got = exact_dedup.exact_groups(docs, fan_in=1).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want and len(got) == len(want)
    assert set(by_id(exact_dedup.keep_unique(docs))) == {i for i, w in want.items() if w[2]}
    assert exact_dedup.exact_groups(none).count() == 0
    out = exact_dedup.exact_groups(odd).collect()
    assert len(out) == odd.count() and sum(r["kept"] for r in out) == len({r["text_sha256"] for r in out})
    assert exact_dedup.keep_unique(odd).count() == len({r["text_sha256"] for r in out})


def test_exact_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 8)
    rows = [(i, "hot text" if i % 3 else f"text {i % 50}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    salted = exact_dedup._rows(docs, 2).groupBy("digest", "salt").count().agg({"count": "max"}).first()[0]
    assert salted <= 16
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, fan_in=2).collect()}
    texts = Counter(t for _, t in rows)
    assert got == {i: (min(j for j, u in rows if u == t), texts[t]) for i, t in rows}


def test_keep_unique_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "k1", "m"), (2, "ab", "k2", "n"), (3, "c", "k3", "o")], "doc_id long, text string, key string, KEY_ string")
    got = sorted(map(tuple, exact_dedup.keep_unique(docs).collect()))
    assert got == [(1, "a b", "k1", "m"), (3, "c", "k3", "o")]
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == sorted(map(tuple, docs.collect()))


def test_keep_unique_of_one_id_keeps_the_longest(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (2, "ab", "z"), (3, None, "v"), (None, " ", "w"), (3, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, member string").repartition(3)
    got = sorted(exact_dedup.keep_unique(docs, fan_in=1).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, "a  b", "y"), (None, " ", "w")]


BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def test_bpe_matches_library(docs, none, odd):
    t, got = library(), by_id(bpe.digest_documents(docs, BYTES))
    full = by_id(bpe.encode_documents(docs, BYTES))
    for i, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))
        assert full[i]["ids"] == ids and full[i]["decoded"] == decoded
    assert bpe.digest_documents(none, BYTES).count() == 0
    assert bpe.digest_documents(odd, BYTES).count() == odd.count()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_matches_library_on_any_text(text):
    assert bpe.codec(BYTES).encode(text) == library_cached().encode(text, add_special_tokens=False).ids


def test_bpe_matches_library_on_every_character():
    c, t = bpe.codec(BYTES), library_cached()
    wrong = [n for n in range(0x3100) if not 0xD800 <= n < 0xE000 and c.encode(s := f"a{chr(n)}b {chr(n)}{chr(n)} 1{chr(n)}\n{chr(n)} ") != t.encode(s, add_special_tokens=False).ids]
    assert wrong == []


def test_bpe_rows_of_short_runs_match_single_trees():
    c = bpe.codec(BYTES)
    runs = [w.encode()[:16] for w in {*LONG[:3000].split(), *BASE.split(), "aaaaaaaaaaaaaaaa", "é", "x", "abababab", " the", "日本語"}]
    ids, counts = c.merge_rows(runs)
    assert [ids[b - n : b] for n, b in zip(counts, np.cumsum(counts))] == [c.merge(r) for r in runs]
    assert c.merge_rows([])[0] == []


def test_bpe_cache_generations_and_windows(monkeypatch):
    texts = [f"word{i} item{i % 7}, <|endoftext|>  it's\n {'z' * 70}{i % 3} ''s x" for i in range(300)] + ["", " ", LONG[:50_000]]
    want = [library_cached().encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "CACHE_RUNS", 40)
    monkeypatch.setattr(bpe, "WINDOW", 32)
    c = bpe.Codec(BYTES)
    for again in range(2):
        got, decoded = [[] for _ in texts], [""] * len(texts)
        for n, ids, text in c.parts(texts):
            got[n] += map(int, ids.split(","))
            decoded[n] += text
        assert got == want and decoded == texts
    assert c.older and not any(len(s) >= bpe.KEPT_CHARS for s in c.cache)


_LIBRARY = []


def library_cached():
    if not _LIBRARY:
        _LIBRARY.append(library())
    return _LIBRARY[0]


def test_toxicity_learns_a_word(spark, none, odd):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "light", "garden", "window", "paper", "season", "mirror"]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" you idiot" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    got = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert all(got[i]["predicted"] == y for i, _, y in rows) and got[900]["score"] == got[901]["score"]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    model = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0


def plain_toxicity(texts, labels):
    """Weights by n-gram hash and the bias: counts by dictionary, dense matrix, gradient steps to the optimum."""
    own = [sorted({int(h) for part in toxicity._hashes(t) for h in part}) for t in texts]
    y, n = np.array(labels, float), len(texts)
    names = sorted({h for o in own for h in o})
    x = np.zeros((n, len(names)))
    for i, o in enumerate(own):
        x[i, [names.index(h) for h in o]] = 1
    p, share = y.sum(), y.mean()

    def ratio(a, b):
        return np.log((a + toxicity.SMOOTHING * share) / p) - np.log((b + toxicity.SMOOTHING * (1 - share)) / (n - p))

    a, b = y @ x, (1 - y) @ x
    seen = x * ratio(a - y[:, None], b - (1 - y)[:, None])
    weight, w, bias = np.where(y > 0, toxicity.TOXIC_WEIGHT, 1.0), np.zeros(len(names)), 0.0
    step = 1 / (toxicity.TOXIC_WEIGHT / 4 * ((seen**2).sum() + len(y)) + toxicity.L2)
    v, vb = w, bias
    for k in range(30_000):
        g = weight * (1 / (1 + np.exp(-(seen @ v + vb))) - y)
        w2, b2 = v - step * (seen.T @ g + toxicity.L2 * v), vb - step * g.sum()
        v, vb = w2 + k / (k + 3) * (w2 - w), b2 + k / (k + 3) * (b2 - bias)
        w, bias = w2, b2
    return dict(zip(names, w * ratio(a, b))), bias


def test_toxicity_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 16)  # texts are hashed in many parts
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    monkeypatch.setattr(toxicity, "STEPS", 200)
    rng = np.random.default_rng(4)
    words = ["river", "stone", "light", "you idiot", "paper", "Season"]
    rows = [(i, " ".join(rng.choice(words, 6))) for i in range(60)]
    rows = [(i, t, int("idiot" in t) if i % 9 else int("river" in t)) for i, t in rows]
    docs = spark.createDataFrame([(i, t, t, 1.0) for i, t, _ in rows] + [(900, None, None, None)], "doc_id long, text string, body string, place double").repartition(3)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(3, 0, "x"), (5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    used = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    weights, bias = plain_toxicity(*zip(*used))
    model = toxicity.fit(docs, labels)
    assert model.bias == pytest.approx(bias, abs=2e-3) and int(np.count_nonzero(model.weights)) <= len(weights)
    np.testing.assert_allclose(model.weights[list(weights)], list(weights.values()), atol=2e-3)
    got = by_id(toxicity.score(docs, model))
    for i, t, _ in rows:
        z = bias + sum(weights.get(int(h), 0) for h in toxicity.features(t))
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3)
    assert got[900]["score"] == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(200)] + [(7, "x" * 10)] * 300, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, 20).collect()
    assert len({r["doc_id"] for r in rows}) <= 20 and len(rows) <= 40 and not any(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert toxicity.sample(docs, labels, 20, max_chars=55).count() == 6 and toxicity.sample(docs, labels, 20, max_chars=1).count() == 1


def test_threshold_counts_from_itself_on(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    exact = toxicity.Model(np.zeros(1 << toxicity.HASH_BITS), 0.0)
    row = toxicity.score(docs, exact).first()
    assert (row["score"], row["predicted"]) == (0.5, 1)


def test_warc_round_trip(spark, monkeypatch):
    pages = [(7, "http://x/a b", "<p>same</p>"), (3, "http://x/ü", "<p>same</p>"), (5, None, None), (9, "http://x/\r\nEvil: 1", ""), (11, "http://x", "a\r\n\r\nWARC/1.1\r\n" * 2000), (12, "u", "日本")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data, r = (html or "").encode(), got[i]
        first = min(j for j, _, h in pages if (h or "") == (html or ""))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.payload_digest(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert r["payload"] == (bytearray(data) if first == i else None)
    few = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(df, min_bytes=5).collect()}
    assert few[7] == "revisit" and few[9] == "response"
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    clash = df.withColumns({"payload": df["url"], "name": df["url"], "first": df["page_id"], "key": df["url"], "refers_to": df["url"]})
    assert {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(clash).collect()} == {i: r["record_type"] for i, r in got.items()}
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)  # several files a task
    many = df.unionByName(spark.range(100, 160).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id, repeat('x', 500)) AS html")).coalesce(2)
    assert warc.archive_round_trip(many).filter("record_type = 'response'").count() == 64
    twice = spark.createDataFrame([(None, "u", "x"), (None, "u", "x"), (1, "u", "y"), (1, "u", "y")], "page_id long, url string, html string")
    assert warc.archive_round_trip(twice).count() == 4
