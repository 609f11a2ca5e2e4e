"""The operators against brute force, round trips and held-out text, and on odd rows."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagesift.llm import (
    chat, entities, language_model, neighbours, packing, pii, quality, sentencepiece_codec, simhash, style_tree, token_counts,
)
from pagesift.llm.common import pick

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    draw = random.Random(seed)
    words = "the of and to in river stone winter garden letter silver night open".split()
    return " ".join(draw.choice(words) + (draw.choice(["", "", ",", "s", str(seed)])) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    texts = [None, "", "   \n ", prose(1, 80), prose(1, 80), "x" * 30_000, prose(2, 20_000), "a😀\x00b ▁ <s> <|endoftext|>"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, None), (None, "nobody's text", "xx", "s", 1), (None, None, None, None, None)]
    names = ["n_tokens", "fingerprint", "kept", "TEXT", "Doc_Id", "a.b", "text_hash", "ids", "hash", "n_words"]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(names):
        df = df.toDF(*df.columns).withColumn(f"x{i}", F.lit(i))
    return df.toDF(*SCHEMA_NAMES, *names)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- codec ---------------------------------------------------------------------


def best_score(codec_pieces, unknown, word):
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 32), end):
            score = codec_pieces.get(word[start:end], unknown if end - start == 1 else -np.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def test_codec_finds_the_best_path_and_round_trips(spark, odd):
    from sentencepiece import sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(path, "rb").read())
    scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
    codec = sentencepiece_codec.Codec(path)
    words = ["▁" + w for w in set(prose(5, 500).split()) | {"naïve", "x" * 40, "日本語", "antidisestablishment", "😀a"}]
    for word in words:
        ids = codec.encode([word[1:]])[0]
        total, at = 0.0, 0
        pieces = [proto.pieces[i] for i in ids]
        for p in pieces:
            total += p.score if p.type == 1 else 0.0
        unknown = sum(c not in scores for c in word)
        total += unknown * codec.unknown_score
        assert total == pytest.approx(best_score(scores, codec.unknown_score, word))
    rows = pick(odd, "doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = sentencepiece_codec.encoded(rows)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decoded(ids).collect()}
    for r in rows.collect():
        assert back[r[0]] == (r[1] or "").replace("▁", " ")
    assert sentencepiece_codec.encoded(empty(spark)).count() == 0
    assert sentencepiece_codec.encoded(odd).count() == odd.count()


def test_round_trip_of_every_row(spark, odd):
    texts = ["", None, "a b  c", " lead and trail ", "\n\nx\t", "é漢😀 " * 40, "x" * 3000, "one ▁ mark", "A b"]
    rows = spark.createDataFrame([*enumerate(texts), (None, "no id"), (None, "no id")], "doc_id long, text string")
    rows = rows.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2)).withColumn("x", F.lit(3))
    rows = rows.toDF("doc_id", "text", "ids", "decoded", "TEXT")
    out = sentencepiece_codec.round_trip(rows).collect()
    assert len(out) == len(texts) + 2
    for row in out:
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        back = text.replace("▁", " ")
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest(), text
        assert row.same == (back == text) and row.n_ids == len(row.ids)
    assert [r.ids for r in out if r.doc_id is None][0] == [r.ids for r in out if r.doc_id is None][1]
    assert sentencepiece_codec.round_trip(odd).count() == odd.count()
    assert sentencepiece_codec.round_trip(odd.limit(0)).count() == 0


# --- personal data -----------------------------------------------------------------


def test_surrogates_are_consistent_and_distinct(spark):
    texts = [f"mail a{i % 40}@mail.example.org or +1 (212) 555-{1000 + i % 60} now" for i in range(120)]
    texts += ["Mr. John Smith met Ms. Anna Miller. JOHN is no mention, Mr. Smith is.", "clean text, nothing here", None]
    out = [r.text for r in pii.with_surrogates(make_docs(spark, texts), "key").orderBy("doc_id").collect()]
    pairs = defaultdict(set)
    for before, after in zip(texts[:120], out):
        a, b = entities.mentions(before), entities.mentions(after)
        assert [m.kind for m in a] == [m.kind for m in b]
        for x, y in zip(a, b):
            pairs[x.kind, x.normal].add(y.normal)
            assert x.normal != y.normal
    assert all(len(v) == 1 for v in pairs.values())
    made = Counter((k[0], *v) for k, v in pairs.items())
    assert max(made.values()) == 1
    assert out[-2:] == texts[-2:]
    assert "Smith" not in out[120] and "Anna" not in out[120]
    families = re.findall(r"Mr\. (?:[A-Z]\w+ )?([A-Z]\w+)", out[120])
    assert len(set(families)) == 1


def test_colliding_draws_are_drawn_again(spark, monkeypatch):
    rows = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(30)], "kind string, normal string")
    few = pii.attempts(rows, b"k").collect()
    assert len({r.value for r in few}) == 30
    # Private addresses have few stand-ins of their kind in one class.
    rows = spark.createDataFrame([("card", f"4{i:012d}") for i in range(300)], "kind string, normal string")
    got = pii.attempts(rows, b"k").collect()
    assert len({r.value for r in got}) == 300 and not {r.value for r in got} & {r.normal for r in got}
    rows = spark.createDataFrame([("phone", f"99{i:02d}") for i in range(80)], "kind string, normal string")
    got = pii.attempts(rows, b"k").collect()
    assert len({r.value for r in got}) == 80 and max(r.attempt for r in got) > 0
    assert all(not r.attempt or r.value != r.normal for r in got)


def test_redrawn_stand_ins_reach_the_texts(spark):
    texts = [f"+33 1{i:02d}0 0000" for i in range(40)] * 2
    out = pii.with_surrogates(make_docs(spark, texts), "k2").orderBy("doc_id").collect()
    assert len({r.text for r in out}) == 40
    assert [r.text for r in out[:40]] == [r.text for r in out[40:]]


# --- pages ------------------------------------------------------------------------


def page(i, host="h.example", extra=""):
    return (
        f"<html><head><title>t{i}</title><script>if (a<b) x('</p>')</script></head><body><div class='top'>"
        f"<a href='/'>Home</a> Same text everywhere</div>{extra}<article><h1>Head {i}</h1><p>First &amp; {prose(i, 9)}"
        f"<p>Second\n  line<br>{i} &lt;</article><div class='low'>Same foot</div><footer>f {i}</footer></body></html>"
    )


def test_style_tree_drops_what_pages_share(spark):
    rows = [(i, "http://h.example/p", page(i)) for i in range(30)]
    body = "<html><body><div class='top'><a href='/'>Home</a> Same all over</div><div class='c'><p>{}</div></body></html>"
    rows += [(100 + i, "http://n.example/p", body.format(f"Text {i} " + prose(i, 12))) for i in range(30)]
    rows += [(500, None, None), (501, "bad", "<p>Lone <b>text"), (502, "http://h.example/x", "<a " * 20_000), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("TEXT", F.lit(1))
    out = {r.page_id: r for r in style_tree.main_text(pages).collect()}
    assert len(out) == len(rows)
    for i in range(30):
        assert out[i].text == f"Head {i}\n\nFirst & {prose(i, 9)}\n\nSecond line {i} <"
        assert out[100 + i].text == f"Text {i} " + prose(i, 12)
        assert out[i].n_chars == len(out[i].text)
    assert out[500].text == "" and out[501].text == "Lone text" and out[502].text == ""
    again = spark.createDataFrame([], "page_id long, url string, html string")
    assert style_tree.main_text(again).count() == 0


def test_importance_is_the_entropy(spark):
    rows = [(1, style_tree.ROWS, 7, 20.0, 0.0), (1, style_tree.PAGES, 0, 20.0, 0.0), (1, style_tree.PIECES, 1, 20.0, 0.0)]
    rows += [(2, style_tree.ROWS, i, 1.0, 0.0) for i in range(20)] + [(2, style_tree.PAGES, 0, 20.0, 0.0)]
    seen = spark.createDataFrame(rows, "node long, kind int, feature long, total double, spread double")
    out = {r.node: r.importance for r in style_tree.importances(seen).collect()}
    assert out[1] == pytest.approx(0.0, abs=1e-9)
    assert out[2] == pytest.approx(1 - 0.9**20)


@pytest.mark.parametrize("piece", ["<a ", "<!x ", '<a h="', "<div", "</p", "<div>", "<p>", "<script>", "&amp"])
def test_broken_markup_is_read_in_linear_time(piece):
    import time

    start = time.perf_counter()
    style_tree.Page(piece * (400_000 // len(piece)))
    assert time.perf_counter() - start < 5


def test_compound_and_repeated_names_are_one_person(spark):
    text = "Mr. Smith met Mr O'Brien and Frau Müller-Schmidt. Smith said O’Brien, Smith's friend, left; Müller-Schmidt stayed. 0171 2345678, 030/1234567"
    found = [(text[m.start : m.end], m.kind, m.normal) for m in entities.mentions(text)]
    assert [f[0] for f in found] == ["Smith", "O'Brien", "Müller-Schmidt", "Smith", "Smith", "Müller-Schmidt", "0171 2345678", "030/1234567"]
    assert len({f[1:] for f in found if f[0] == "Smith"}) == 1
    after = pii.with_surrogates(make_docs(spark, [text, "Smith said nothing.", None]), "key").orderBy("doc_id").collect()
    first = after[0].text
    assert "Smith" not in first and "Müller" not in first and "Brien met" not in first
    stand_in = first.split("Mr. ")[1].split(" met")[0]
    assert f". {stand_in} said" in first and f", {stand_in}'s friend" in first
    # Without a title or a given name a word is no name.
    assert after[1].text == "Smith said nothing." and after[2].text is None


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><p>First one.</p></article><article><p>Second one, longer.</p></article>", "First one.\n\nSecond one, longer."),
        ("<p>x</p><div class='share-price'><p>The price of a share rose by a tenth.</p></div>", "x\n\nThe price of a share rose by a tenth."),
        ("<article class='share-price'><p>Rose.</p><div class='share-buttons'>Tweet</div></article>", "Rose."),
        ("<article><p>Real text.</p><div class='comments'><p>Nice! " + "So nice. " * 40 + "</p></div></article>", "Real text."),
        ("<p>Real text.</p><div id='comment-list'>" + "So nice. " * 4 + "</div>", "Real text."),
        ("<main><p>It holds that <math><mi>a</mi></math> is so.</p><select><option>b</select></main>", "It holds that a is so."),
        ("<article class='teaser related'>Elsewhere</article><article>Here</article>", "Here"),
        ("<div class='nav'><div class='ad'>a</div></div>", ""),
    ],
)
def test_names_decide_only_between_branches(body, text):
    assert style_tree.Page(f"<html><body><nav>Menu</nav>{body}</body></html>").text("h", set()) == text


# --- neighbours ----------------------------------------------------------------------


def test_neighbours_among_copies_go_by_id(spark):
    """A third of all vectors are equal: their neighbours are the copies with the smallest ids."""
    draw = np.random.default_rng(8)
    data = draw.standard_normal((6000, 32))
    copies = draw.permutation(6000)[:2000]
    data[copies] = data[copies[0]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    # Repeated ids are one vector's.
    df = df.unionByName(df.filter("vec_id < 40"))
    assert len(neighbours.fitted_pivots(df.withColumnRenamed("embedding", "vector"))) == neighbours.PIVOTS
    found = defaultdict(list)
    for r in neighbours.nearest(df, shard_rows=3000).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    hits = 0
    for q in range(0, 6000, 50):
        scores = (unit * unit[q]).sum(1)
        best = [int(i) for i in np.lexsort((np.arange(6000), -scores)) if i != q][:5]
        mine = [v for _, v in sorted(found[q])]
        if q in copies:
            assert mine == [int(c) for c in sorted(copies) if c != q][:5]
        hits += len(set(best) & set(mine))
    assert hits >= 0.9 * 5 * 120


def test_neighbours_reach_their_recall(spark):
    draw = np.random.default_rng(3)
    data = draw.standard_normal((1500, 16)).astype(np.float32)
    data[700] = data[50]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    found = neighbours.nearest(df, shard_rows=400).collect()
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        scores = unit @ unit[q]
        for r in mine:
            assert r.score == pytest.approx(scores[r.vec_id], abs=1e-12)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        scores[q] = -9
        hits += len({r.vec_id for r in mine} & set(np.lexsort((np.arange(1500), -scores))[:5].tolist()))
    assert hits / (5 * 30) >= 0.9
    assert len(found) == 150
    few = neighbours.nearest(df.filter("vec_id < 3 or vec_id = 50"))
    assert few.count() == 6
    assert neighbours.nearest(df.filter("false")).count() == 0


def test_footrule(spark):
    index = neighbours.InvertedFile(np.eye(3), np.eye(3), 2)
    order = neighbours.places(np.eye(3), np.eye(3), 2)
    for q in range(3):
        want = []
        for o in range(3):
            place = {p: i for i, p in enumerate(order[o])}
            want.append(sum(abs(i - place.get(p, 2)) for i, p in enumerate(order[q])))
        assert index.footrule(order[q]).tolist() == want


# --- token counts -------------------------------------------------------------------


def test_token_counts_are_the_library_s(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = odd.collect()
    out = token_counts.count_tokens(odd).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in out)
    assert token_counts.count_tokens(empty(spark)).count() == 0


# --- quality --------------------------------------------------------------------------


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)
    )


def test_quality_counts_and_verdicts(spark, odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality.quality(odd).collect()
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in out) == Counter((r[0], *counted(r[1])) for r in odd.collect())
    good = [prose(i, 300) for i in range(60)]
    bad = [" ".join(w.upper() + "!!$$%%" for w in prose(i, 300).split()) for i in range(100, 104)]
    repeats = "one two three four five six\n" * 5 + "one two three four five six seven"
    texts = [*good, *bad, repeats, "short text", "a\n\nb\nb \nb"]
    got = {r.doc_id: r for r in quality.quality(make_docs(spark, texts)).collect()}
    assert all(tuple(got[i][n] for n in names) == counted(t) for i, t in enumerate(texts))
    assert all(got[i].kept for i in range(60)) and not any(got[60 + i].kept for i in range(6))
    assert got[64].base_failed and got[65].base_failed and not got[60].base_failed
    kept = quality.kept_documents(make_docs(spark, texts))
    assert kept.columns == SCHEMA_NAMES and kept.count() == 60
    assert quality.quality(empty(spark)).count() == 0


def test_distance(spark):
    got = spark.range(1).select(
        quality.distance(F.array(*map(F.lit, [1, 1, 0])), F.array(*map(F.lit, [1, 1, 0]))).alias("same"),
        quality.distance(F.array(*map(F.lit, [5, 0])), F.array(*map(F.lit, [0, 9]))).alias("apart"),
    ).first()
    assert got.same == 0 and got.apart == pytest.approx(1)


# --- language model -------------------------------------------------------------------


def test_pseudo_likelihood_tells_text_from_shuffled_text(spark):
    draw = random.Random(0)
    chain = {w: draw.sample("abcdefghij", 2) for w in "abcdefghij"}

    def walk(n):
        out = ["a"]
        while len(out) < n:
            out.append(draw.choice(chain[out[-1]]))
        return out

    train = make_docs(spark, [" ".join(walk(400)) for _ in range(150)])
    held = [walk(300) for _ in range(12)]
    mixed = [draw.sample(w, len(w)) for w in held]
    test = make_docs(spark, [" ".join(w) for w in held + mixed] + ["", None])
    got = {r.doc_id: r for r in language_model.scored(test, train).collect()}
    assert all(got[i].mean_log_prob > got[12 + i].mean_log_prob + 0.2 for i in range(12))
    assert got[24].log_prob == 0 and got[24].mean_log_prob is None and got[25].n_tokens == 0


def test_gradients_and_probabilities(spark, odd):
    model = language_model.start_model()
    draw = np.random.default_rng(1)
    windows = draw.integers(0, language_model.SIZE, (40, 4))
    full = sum(np.exp(language_model.log_probabilities(model, windows[:1], np.array([t]))) for t in range(language_model.SIZE))
    assert full == pytest.approx(1, abs=1e-3)
    targets = draw.integers(0, language_model.SIZE, 40)
    grads = language_model.gradients(model, windows, targets)
    for key, at in (("mix", (3, 5)), ("embedding", tuple([windows[0, 0], 2])), ("bias", (4,)), ("class_bias", (targets[0] // 64,))):
        steps = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in model.items()}
            moved[key][at] += step
            steps.append(-language_model.log_probabilities(moved, windows, targets).mean())
        assert grads[key][at] == pytest.approx((steps[0] - steps[1]) / 2e-2, abs=2e-4)
    assert language_model.scored(odd).count() == odd.count()
    assert language_model.scored(empty(spark)).count() == 0


def test_words_of_a_bucket_are_scored_as_themselves(spark):
    listed = language_model.SIZE - language_model.BUCKETS
    common = [f"common{i}" for i in range(listed)]
    first = "rare0"
    second = next(w for w in (f"rare{i}" for i in range(1, 9999)) if language_model.bucket(w) == language_model.bucket(first))
    third = next(w for w in (f"new{i}" for i in range(9999)) if language_model.bucket(w) == language_model.bucket(first))
    texts = [" ".join(common * 5), f"{first} {second} {first}", *[f"common1 {w} common2" for w in (first, second, third)]]
    got = {r.doc_id: r for r in language_model.scored(make_docs(spark, texts), make_docs(spark, texts[:2])).collect()}
    # One more part for the words that were never counted than there are words in the bucket.
    assert got[2].log_prob - got[3].log_prob == pytest.approx(np.log(2))
    assert got[3].log_prob - got[4].log_prob == pytest.approx((len(third) + 1) * np.log(257) - np.log(3))
    own = {r.doc_id: r for r in language_model.scored(make_docs(spark, texts[:4])).collect()}
    assert own[2].log_prob - own[3].log_prob == pytest.approx(np.log(3 / 2))


def test_words_are_coded_as_one_by_one():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    known = {w: i for i, w in enumerate(words[:20])}
    texts = ["", *(" ".join(draw.choices(words, k=draw.randrange(40))) for _ in range(30)), "W1  w55\n"]
    codes, places, tokens, unlisted = language_model.Codes(known), {}, [], []
    for some in (texts[:1], texts[1:9], texts[9:]):
        got = codes.coded(some)
        tokens += got[0]
        unlisted += got[1]
    for i, text in enumerate(texts):
        plain = language_model.words_of(text)
        first = language_model.SIZE - language_model.BUCKETS
        assert np.frombuffer(tokens[i], "<u2").tolist() == [known.get(w, first + language_model.bucket(w)) for w in plain]
        other = [places.setdefault(w, len(places)) for w in plain if w not in known]
        assert np.frombuffer(unlisted[i], "<u4").tolist() == other
    # Nothing is remembered beyond the chunk's own words.
    assert codes.unlisted() == [*places] and len(codes) == len(known) + len(places)


class Asked(language_model.Codes):
    """Codes that remember how often they are asked."""

    asked = 0

    def __getitem__(self, word):
        self.asked += 1
        return super().__getitem__(word)


def test_a_word_is_looked_up_once_however_often_it_comes():
    codes = Asked({"the": 0})
    tokens, unlisted = codes.coded(["the rare the THE", "", "rare the rare"] * 50)
    assert codes.asked == 2
    first = language_model.SIZE - language_model.BUCKETS + language_model.bucket("rare")
    assert np.frombuffer(b"".join(tokens[:3]), "<u2").tolist() == [0, first, 0, 0, first, 0, first]
    assert [len(t) for t in tokens[:3]] == [8, 0, 6] and [len(u) for u in unlisted[:3]] == [4, 0, 8]


def test_words_are_split_as_python_splits_them():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["", " ", "\n\x1c a  b\u3000", "\u0130\u03a3 \u03a3A\u03a3", "\0 a\0b", "x".join(points), " ".join(points)]
    got = language_model.words_in(texts)
    assert got.flatten().to_pylist() == [w for t in texts for w in language_model.words_of(t)]
    assert got.value_lengths().fill_null(0).to_pylist() == [len(language_model.words_of(t)) for t in texts]
    assert language_model.words_in([]).flatten().to_pylist() == []


def test_counts_are_those_of_all_words(spark):
    texts = ["A b a", "", None, " b\u2003c ", "b" * 70000 + " a"]
    rows = make_docs(spark, texts).select(F.coalesce("text", F.lit("")).alias("text"))
    got = {r["word"]: r["n"] for r in language_model.word_counts(rows).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "b" * 70000: 1}


def test_windows_and_their_tokens_in_order():
    draw = np.random.default_rng(3)
    for sizes in ([], [0], [1], [0, 3, 1, 0, 200, 7]):
        documents = [draw.integers(0, 30, n).astype("<u2") for n in sizes]
        sequence = language_model.Sequence([d.tobytes() for d in documents])
        edge = [language_model.EDGE] * 2
        plain = [[*edge, *d, *edge][i : i + 5] for d in (d.tolist() for d in documents) for i in range(len(d))]
        windows = sequence.windows(sequence.places)
        assert windows.tolist() == [w[:2] + w[3:] for w in plain]
        if plain:
            order, tokens, starts = language_model.sorted_by_token(windows)
            at = windows.ravel()
            assert np.array_equal(order, np.argsort(at, kind="stable"))
            assert np.array_equal(tokens, np.unique(at)) and np.array_equal(starts, np.searchsorted(np.sort(at), tokens))


def test_sums_of_a_class_do_not_hang_on_where_it_lies():
    draw = np.random.default_rng(5)
    values = draw.random((700, 64), np.float32)
    groups = [(0, slice(0, 3)), (4, slice(3, 690)), (5, slice(690, 700))]
    got = language_model.totals(values.copy(), groups)
    assert np.allclose(got, values.sum(axis=1))
    for _, rows in groups:
        assert np.array_equal(got[rows], language_model.totals(values[rows], [(0, slice(None))]))
    model = language_model.start_model()
    windows, targets = draw.integers(0, 50, (300, 4)), draw.integers(0, language_model.SIZE, 300)
    whole = language_model.flat_gradients(model, windows, targets)
    assert np.array_equal(whole, language_model.flat(language_model.gradients(model, windows, targets)))


def test_a_new_process_does_not_take_its_memory_again_for_each_batch():
    code = (
        "import resource, numpy as np\n"
        "from pagesift.llm import language_model\n"
        "language_model.keep_memory()\n"
        "faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt\n"
        "take = lambda: np.ones(3 << 20, np.uint8)\n"
        "take(); begun = faults()\n"
        "for _ in range(20): take()\n"
        "print(faults() - begun)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    # Pages of 4 KB, once; each time would be 15,000.
    assert int(done.stdout) < 2000


def test_training_adds_up_each_row(spark):
    model = language_model.start_model()
    draw = np.random.default_rng(2)
    windows, targets = draw.integers(0, 50, (300, 4)), draw.integers(0, language_model.SIZE, 300)
    whole = language_model.gradients(model, windows, targets)
    single = [language_model.gradients(model, windows[i : i + 1], targets[i : i + 1]) for i in range(300)]
    for key, values in whole.items():
        assert np.allclose(values, sum(s[key] for s in single) / 300, atol=1e-5)
    # A step changes the trainer's weights and not the model it began with.
    before, trainer = language_model.flat(model), language_model.Trainer(model)
    trainer.learn(language_model.Sequence([targets.astype("<u2").tobytes()]))
    assert np.array_equal(language_model.flat(model), before)
    assert not np.array_equal(language_model.flat(trainer.model), before)


def test_shares_are_joined_without_sorting_the_words(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 2)], "word string, n long")
    words = spark.createDataFrame([(0, 0, "a"), (0, 1, "never")], "chunk long, place int, word string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = language_model.Shares(counts, {}).of(words)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert joined.count() == 2


# --- near-duplicates --------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if i < j and (a ^ b).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_near_duplicates_match_brute_force(spark, odd):
    draw = random.Random(4)
    texts = []
    for g in range(12):
        words = prose(g, 400).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 2])):
                copy[draw.randrange(400)] = "changed" + str(draw.random())
            texts.append(" ".join(copy))
    texts += [None, "", "one two", "one two", "ONE  two"]
    out = {r.doc_id: r for r in simhash.near_duplicates(make_docs(spark, texts)).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert {i: r.fp & (2**64 - 1) for i, r in out.items()} == dict(prints)
    assert {i: r.component_id for i, r in out.items()} == plain_components(prints)
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(make_docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(prints).values()))


def test_tight_and_chained_fingerprints(spark):
    draw = random.Random(9)
    centre = draw.getrandbits(64)
    values = {centre ^ sum(1 << b for b in draw.sample(range(20), draw.randrange(6))) for _ in range(500)}
    chain = [draw.getrandbits(64)]
    for _ in range(40):
        chain.append(chain[-1] ^ sum(1 << b for b in draw.sample(range(64), 4)))
    values |= set(chain) | {draw.getrandbits(64) for _ in range(100)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in simhash.linked_roots(fps).collect()}
    want = plain_components([(v, v & (2**64 - 1)) for v in signed])
    assert {v: got.get(v, v) for v in signed} == want


def test_crowded_keys_link_by_balls(spark):
    """However few members a key may pair, the components are those of brute force."""
    draw = random.Random(12)
    centre = draw.getrandbits(64)
    values = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(7))) for _ in range(700)}
    values |= {draw.getrandbits(64) for _ in range(60)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    prints = np.array(signed, np.int64).view(np.uint64)
    for bits in (4, 3):
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
        label = np.arange(len(signed))
        while (label != (label := np.where(near, label[None, :], len(signed)).min(1))).any():
            pass
        want = {v: signed[i] for v, i in zip(signed, label)}
        for crowded in (simhash.CROWDED, 30, 2):
            got = {r.node: r.root for r in simhash.linked_roots(fps, bits, crowded).collect()}
            assert {v: got.get(v, v) for v in signed} == want


def test_rows_of_each_step_are_bounded_by_fingerprint(spark):
    """A group of 4,000 near copies gives at most a constant of rows each, as its keys are not paired."""
    draw = random.Random(13)
    centre = draw.getrandbits(64)
    values = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5))) for _ in range(4000)}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").cache()
    links = simhash.key_links(simhash.tables(fps), simhash.BITS, 300)
    assert links.count() <= 66 * fps.count()
    assert links.filter("b is null").count() > 0
    assert simhash.sure_links(fps, simhash.BITS).count() <= 2081 * fps.count()


def test_one_of_each_takes_columns_by_place(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    again = simhash.one_of_each(kept.toDF(*kept.columns))
    assert again.count() == kept.count()


# --- packing --------------------------------------------------------------------------


def test_packing_keeps_every_token(spark, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = make_docs(spark, [prose(i, 30 + 37 * i) for i in range(60)] + [None, "", "<|endoftext|> x", "a\r\n\t  b  " * 99])
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc in docs.collect():
        ids = [*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc.doc_id], key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        for p in pieces:
            data = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(data) == p.ids_crc32
    sizes = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        sizes.append(sum(p.length for p in pieces))
    assert max(sizes) <= 1024 and sum(s < 1024 for s in sizes) <= 1
    assert len({(r.doc_id, r.start) for r in packing.pack(odd).collect()}) > 0
    assert packing.pack(empty(spark)).count() == 0


def test_seeds_fetch_their_own_kind():
    draw = np.random.default_rng(5)
    topics = [np.arange(100 * k + 1, 100 * k + 60, dtype=np.uint32) for k in range(5)]
    tails = [draw.permutation(topics[i % 5])[:50] for i in range(40)]
    together = defaultdict(set)
    for doc, _, _, sequence, _ in packing.fill(tails, 200):
        together[sequence].add(doc % 5)
    assert np.mean([len(v) for v in together.values()]) < 2


def test_scores_are_those_of_a_plain_bm25():
    """All terms of whole documents, long and empty-tailed ones too; rows and postings give the same."""
    draw = np.random.default_rng(8)
    docs = [(draw.zipf(1.4, size=int(draw.integers(1, 900))) % 500).astype(np.uint32) for _ in range(60)]
    docs += [docs[0], docs[0], np.zeros(1, np.uint32)]
    n, mean = len(docs), np.mean([len(d) for d in docs])
    held = [Counter(d.tolist()) for d in docs]
    df = Counter(t for h in held for t in h)
    idf = {t: np.log1p((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    terms = [packing.terms_of(d) for d in docs]
    for share in (0.0, 1 / 8, 2.0):
        index = packing.Index(terms, share)
        for seed in (0, 7, 60, 62):
            want = [
                sum(idf[t] * h[t] * (packing.K1 + 1) / (h[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in held[seed] if t in h)
                for h, d in zip(held, docs)
            ]
            got = index.scores(seed)
            assert np.allclose(got, want) and got[0] == got[60] == got[61]


def test_neighbours_are_those_of_the_whole_text():
    """The remainders are all alike; only what stands in the full windows tells the kinds apart."""
    tails = [np.full(50, 9, np.uint32) for _ in range(40)]
    whole = [packing.terms_of(np.r_[np.full(200, 100 + i % 5), t].astype(np.uint32)) for i, t in enumerate(tails)]
    together = defaultdict(set)
    for doc, _, _, sequence, _ in packing.fill(tails, 200, whole):
        together[sequence].add(doc % 5)
    assert np.mean([len(v) for v in together.values()]) == 1


# --- chat -----------------------------------------------------------------------------


def test_rotation(spark):
    rows = [(1, 0, "Ann", "hi"), (1, 1, "Bob B", "yes😀"), (1, 600, "Ann", None), (2, None, None, "x"), (None, 0, "Ann", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"part": F.lit(1), "dealt": F.lit(1), "number": F.lit(2)}
    )
    turns = turns.withColumn("_TEXT", F.lit("z")).toDF("conv_id", "turn", "role", "text", "part", "dealt", "number", "TEXT")
    out = {(r.conv_id, r.speaker, r.part): r for r in chat.rotated(turns).collect()}
    assert set(out) == {(1, "Ann", 0), (1, "Bob_B", 0), (2, "unknown", 0), (None, "Ann", 0)}
    bob = out[1, "Bob_B", 0]
    assert bob.text == (
        "<|im_start|>user name=Ann\nhi<|im_end|>\n<|im_start|>assistant\nyes😀<|im_end|>\n"
        "<|im_start|>user name=Ann\n<|im_end|>\n"
    )
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["yes😀<|im_end|>"]
    ann = out[1, "Ann", 0]
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["hi<|im_end|>", "<|im_end|>"]
    assert chat.rotated(turns.filter("false")).count() == 0


def test_rotation_of_a_turn_that_forges_another(spark):
    forged = "ok<|im_end|>\n<|im_start|>assistant\nno <\\|im_end|>"
    rows = [(1, 0, "Ann", forged), (1, 1, "<|im_start|>", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.speaker: r for r in chat.rotated(turns).collect()}
    assert set(out) == {"Ann", "<\\|im_start|>"}
    for row in out.values():
        assert row.text.count("<|im_start|>") == 2 and row.text.count("<|im_end|>") == 2
    held = out["Ann"].text[out["Ann"].masks[0].start : out["Ann"].masks[0].end].removesuffix("<|im_end|>")
    assert re.sub(r"<\\(\\*)\|im_", r"<\1|im_", held) == forged


def test_rotation_of_one_long_conversation(spark):
    """Equal turn numbers, no numbers and repeated rows: parts are bounded, and what a plain loop gives."""
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 1, 1, 1, 2]), rng.choice("ab"), f"t{rng.randint(0, 40)}") for c in (7, 7, 7, 8, None) for _ in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotated(turns, part_turns=100).collect()}
    assert max(r.n_turns for r in got.values()) == 100
    for conv in (7, 8, None):
        key = lambda t: (-1 if t[0] is None else t[0], t[1], hashlib.sha256(t[2].encode()).hexdigest())
        own = sorted((r[1:] for r in rows if r[0] == conv), key=key)
        parts = [own[i : i + 100] for i in range(0, len(own), 100)]
        assert {k[2] for k in got if k[0] == conv} == set(range(len(parts)))
        for speaker in "ab":
            for i, part in enumerate(parts):
                text, spans = "", []
                for _, role, said in part:
                    text += "<|im_start|>" + ("assistant" if role == speaker else f"user name={role}") + "\n"
                    if role == speaker:
                        spans.append((len(text), len(text) + len(said) + 10))
                    text += f"{said}<|im_end|>\n"
                row = got[conv, speaker, i]
                assert row.text == text and [(m.start, m.end) for m in row.masks] == spans


# --- pipeline -------------------------------------------------------------------------


def test_pipeline_stages(spark):
    texts = [prose(i, 260) + f" mail u{i}@example.org" for i in range(30)]
    texts += [texts[0], texts[1] + " end", "too short", None]
    docs = make_docs(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), "stage")
        assert docs.columns == SCHEMA_NAMES
    kept = {r.doc_id: r for r in docs.collect()}
    assert 30 not in kept and 32 not in kept and 33 not in kept and 0 in kept
    assert all("example.org" not in r.text or r.text != texts[i] for i, r in kept.items())
    assert all(r.n_chars == len(r.text) for r in kept.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Clashing names, null ids and repeated rows go through every stage; empty tables too."""
    texts = [(i, prose(i, 260), "en", "s", 0, i) for i in range(12)] + [(None, prose(50, 260), "en", "s", 0, 1)] * 2
    names = [*SCHEMA_NAMES, "TEXT", "_text_hash", "n_entities", "Doc_Id", "n_words", "kept"]
    docs = spark.createDataFrame(texts, SCHEMA + ", x long").select("*", *[F.lit(i).alias(f"y{i}") for i in range(5)]).toDF(*names)
    for one in (docs, odd, docs.limit(0)):
        held = one
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, "")
            assert held.columns == one.columns, name
        assert held.count() <= one.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_pipeline_runs_from_a_folder(spark, tmp_path):
    """``run`` gives the rows of its stages called one by one, and takes extra columns."""
    texts = [prose(i, 260) for i in range(25)]
    texts += [texts[0], texts[1] + " end", "too short", None]
    docs = make_docs(spark, texts).withColumn("_text_hash", F.lit("mine")).withColumn("n_entities", F.lit(3))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    held = docs
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, str(tmp_path))
    tokens = lambda df: {(r.doc_id, r.doc_tokens) for r in df.collect()}
    assert tokens(found) == tokens(held)
    assert {r.doc_id for r in found.collect()} == set(range(25))
    lengths = defaultdict(int)
    for r in found.collect():
        lengths[r.doc_id, r.doc_tokens] += r.length
    assert all(total == doc_tokens for (_, doc_tokens), total in lengths.items())
