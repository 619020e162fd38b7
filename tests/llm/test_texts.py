"""Encoding, leaks and languages."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orebody.llm.encode import TreeEncoder, decode_corpus, encode_corpus
from orebody.llm.langid import classified, fit_languages, identify_languages, languages_held, repaired, sentences, train
from orebody.llm.leaks import LeakIndex, find_leaks, words_of
from tests.conftest import tuples

SMALL, BIG = TreeEncoder(leaf=3), TreeEncoder(leaf=1 << 30)
PIECES = st.sampled_from([" ", "  ", "\n", "\t", " ", "a", "The", "'s", "'ll", "'", "l", "é", "9", "12", "!", "...", "。", "、", "東京", "きのこ", "Ж", "🙂", "​", "<|endoftext|>", "x" * 40, " " * 40, "ß", "﻿", "\x00", "٣", "ำ"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=40))
def test_tree_equals_whole(parts):
    text = "".join(parts)
    want = BIG.encoding.encode_ordinary(text)
    assert SMALL.encode(text) == BIG.encode(text) == want
    assert SMALL.decode(want) == text
    for cut in {0, len(text) // 3, len(text)}:
        left, right = text[:cut], text[cut:]
        assert SMALL.join(left, SMALL.encode(left), right, SMALL.encode(right)) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(text):
    assert SMALL.encode(text) == BIG.encoding.encode_ordinary(text)
    assert SMALL.decode(SMALL.encode(text)) == text


def test_corpus_ids(rows):
    long = "A walk, a talk; 42 more! " * 4000
    df = rows([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (4, long, 0), (1, "Hello world", 0), (None, "x", 0)], "doc_id bigint, text string, ids int")
    got = encode_corpus(df, key="doc_id", text="text")
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[1] == [15496, 995] and by[2] == by[3] == [] and by[4] == BIG.encode(long)
    assert got.count() == 6
    assert {r.doc_id: r.text for r in decode_corpus(got, key="doc_id").collect()}[4] == long
    assert encode_corpus(df.where("false"), key="doc_id", text="text").count() == 0


def brute(docs, items, n):
    def has(words, run):
        return any(words[k : k + len(run)] == run for k in range(len(words) - len(run) + 1))

    out = set()
    for d, text in docs:
        words = words_of(text)
        for i, passage in items:
            p = words_of(passage)
            if p and any(has(words, p[k : k + n]) for k in range(max(1, len(p) - n + 1))):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(rows):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(30)] + ["Ärger", "東京", "O'Neil", "x9"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([3, 8, 11, 12, 13, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "...")]
    docs = [(0, None), (1, ""), (2, "!?")]
    for d in range(3, 90):
        text = say(rng.randint(0, 60))
        if rng.random() < 0.6:
            p = words_of(rng.choice(items[:25])[1])
            k = rng.randint(0, len(p))
            text += rng.choice([", ", "\n", " "]) + rng.choice([" ", "-", ";\n"]).join(w.upper() for w in p[max(0, k - 14) : k + rng.randint(0, 14)]) + " " + say(3)
        docs.append((d, text))
    docs.append((500, "filler, " * 60_000 + items[-4][1]))
    df = rows([(*d, 7, "x") for d in [*docs, docs[5]]], "doc_id bigint, text string, item_id int, passage string")
    ev = rows([*items, items[0]], "item_id bigint, passage string")
    want = brute(docs, items, 12)
    form = {"doc": "doc_id", "text": "text", "item": "item_id", "passage": "passage"}
    assert len(want) > 20
    assert {tuple(r) for r in find_leaks(df, ev, **form).collect()} == want
    assert {tuple(r) for r in find_leaks(df, ev, block=4, **form).collect()} == want
    assert find_leaks(df.where("false"), ev, **form).count() == find_leaks(df, ev.where("false"), **form).count() == 0


def changed(rng, words, kind):
    k = rng.randrange(len(words))
    return {"replace": words[:k] + ["zzz"] + words[k + 1 :], "drop": words[:k] + words[k + 1 :], "insert": words[:k] + ["zzz"] + words[k:]}[kind]


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("kind", ["replace", "drop", "insert"])
@pytest.mark.parametrize("size", [12, 14])
def test_recall_of_near_leaks(edits, kind, size):
    """Each kind and number of edits, at any place; the words around could belong to a passage too."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(words, size))) for i in range(200)]
    index = LeakIndex(items, 12, edits, 16, 3, 5)
    got, wrong = 0, 0
    for i, passage in items:
        p = passage.split()
        for _ in range(edits):
            p = changed(rng, p, kind)
        text = [rng.choice(words) for _ in range(5)] + p + ["zzz"] * 3
        found = {int(x) for _, who in index.matches(np.array([index.vocabulary.get(w, -1) for w in [*text, "zzz"]] + [-2], np.int64)) for x in who}
        got += i in found
        wrong += len(found - {i})
    assert got >= 0.9 * len(items) and not wrong


def test_near_leaks_in_tables(rows):
    passage = "the quick brown fox jumps over a very lazy dog near here today"
    texts = [(1, passage.upper()), (2, passage.replace("fox", "wolf")), (3, passage.replace("fox ", "")), (4, "over a very lazy"), (5, None), (6, passage.replace("fox", "wolf").replace("lazy", "old").replace("today", "now")), (7, "so " + passage.replace("brown", "brown red"))]
    df, ev = rows(texts, "doc_id bigint, text string"), rows([(9, passage), (8, "one two three"), (7, None)], "item_id bigint, passage string")
    form = {"doc": "doc_id", "text": "text", "item": "item_id", "passage": "passage"}
    assert {tuple(r) for r in find_leaks(df, ev, edits=1, **form).collect()} == {(1, 9), (2, 9), (3, 9), (7, 9)}
    assert find_leaks(df.where("false"), ev, edits=1, **form).count() == find_leaks(df, ev.where("false"), edits=2, **form).count() == 0


TEMPLATES = {
    "en": ["We waited {} minutes at {} before the soup arrived.", "Would I return to {1} for the {0} cakes?", "The owner of {1} was friendly and the bill was {0} dollars."],
    "de": ["Wir haben {} Minuten bei {} auf die Suppe gewartet.", "Ob ich wegen der {0} Kuchen zu {1} zurückkomme?", "Der Besitzer von {1} war freundlich und die Rechnung lag bei {0} Euro."],
    "fr": ["Nous avons attendu la soupe {} minutes chez {}.", "Est-ce que je reviendrais chez {1} pour les {0} gâteaux ?", "Le patron de {1} était aimable et l'addition de {0} euros."],
    "ja": ["{1}でスープを{0}分待ちました。", "{1}のケーキを{0}個食べにまた行きますか。", "{1}の店長は親切で、会計は{0}円でした。"],
}


def say(rng, language, n):
    names = ["Bakelo", "Rivomat", "Tusen", "Marfil", "Odenu"]
    return " ".join(rng.choice(TEMPLATES[language]).format(rng.randint(2, 300), rng.choice(names)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(23)
    return [(k, say(rng, language, rng.randint(1, 5)), language if rng.random() < 0.9 else rng.choice(list(TEMPLATES)), language) for k in range(600) for language in [rng.choice(list(TEMPLATES))]]


def test_languages_of_held_out_texts(rows, corpus):
    docs = rows([(k, t, label) for k, t, label, _ in corpus], "doc_id bigint, text string, lang string")
    aliases = rows([(x, x) for x in TEMPLATES] + [("en", "en"), (None, "de")], "label string, lang string")
    model = fit_languages(docs, aliases, key="doc_id", text="text", label="lang", alias="label", language="lang")
    rng = random.Random(99)
    tests = [(k, say(rng, a, 2), {a}) for k, a in enumerate(random.Random(1).choices(list(TEMPLATES), k=100))]
    tests += [(k + 100, f"{say(rng, a, 2)}\n{say(rng, b, 1)}", {a, b}) for k, (a, b) in enumerate((rng.sample(list(TEMPLATES), 2)) for _ in range(100))]
    hard = [(900, None), (901, ""), (902, "★★★"), (903, "12345 !!!"), (904, say(rng, "en", 3000)), (905, "<p>" + say(rng, "de", 2) + "</p> <br/>")]
    df = rows([(k, t, "x") for k, t, _ in tests] + [(k, t, "x") for k, t in hard], "doc_id bigint, text string, segments string")
    got = {r.doc_id: r for r in identify_languages(df, model, key="doc_id", text="text").collect()}
    right = sum({x.lang for x in got[k].languages} == want for k, _, want in tests)
    assert right >= 0.97 * len(tests)
    assert all(got[k].languages == [] for k in (900, 901, 902, 903))
    assert [x.lang for x in got[904].languages] == ["en"] and [x.lang for x in got[905].languages] == ["de"]
    for k, t, _ in tests:
        ends = [(s.start, s.end) for s in got[k].segments]
        assert all(a < b <= len(t) for a, b in ends) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))
        assert all(0 <= s.confidence <= 1.0001 for s in got[k].segments)
    assert all(r.languages == [] for r in identify_languages(df, None, key="doc_id", text="text").collect())
    assert fit_languages(docs.where("false"), aliases, key="doc_id", text="text", label="lang", alias="label", language="lang") is None


def held_by(model, texts):
    return [{x for x, _ in languages_held(own, model)} for own in classified([sentences(t) for t in texts], model)]


def fitted(corpus, **more):
    pairs = [(s.words, label) for _, t, label, _ in corpus for s in sentences(t)]
    return train([w for w, _ in pairs], [x for _, x in pairs], **more)


def test_borrowed_words_do_not_count(corpus):
    text = "We waited 20 minutes at Tusen before the soup arrived. (crème brûlée) The owner of Odenu was friendly. Est-ce que?"
    assert held_by(fitted(corpus), [text]) == [{"en"}]


@pytest.mark.parametrize("seed", range(10))
def test_every_draw_of_the_fit_is_sound(seed):
    """Recall and precision of each language on held-out texts, though a tenth of the labels is wrong."""
    rng = random.Random(seed)
    sample = [(k, say(rng, a, rng.randint(1, 5)), a if rng.random() < 0.9 else rng.choice(list(TEMPLATES)), a) for k in range(300) for a in [rng.choice(["en", "en", "en", *TEMPLATES])]]
    model = fitted(sample, seed=seed)
    assert 0.5 <= model.reject <= 0.9
    tests = [(say(rng, a, 3), {a}) for a in TEMPLATES for _ in range(40)] + [(say(rng, a, 2) + " " + say(rng, b, 2), {a, b}) for a in TEMPLATES for b in TEMPLATES if a != b for _ in range(4)]
    got = held_by(model, [t for t, _ in tests])
    for a in TEMPLATES:
        true, found = [a in want for _, want in tests], [a in own for own in got]
        both = sum(x and y for x, y in zip(true, found))
        assert both >= 0.95 * sum(true) and both >= 0.95 * sum(found)


def test_a_fit_that_is_not_finite_is_an_error(corpus):
    with pytest.raises(ArithmeticError), np.errstate(all="ignore"):
        fitted(corpus[:100], rate=float("inf"))


def test_long_tags_are_markup():
    (one,) = sentences(f'<a href="{"x y " * 200}">Hello there</a>')
    assert one.words == ["hello", "there"]


def test_columns_kept_beside(rows, corpus):
    df = rows([(k, t, label) for k, t, label, _ in corpus[:20]] + [(99, None, None)], "doc_id bigint, text string, lang string")
    got = identify_languages(df, fitted(corpus), key="doc_id", text="text", keep=["lang"])
    assert got.columns == ["doc_id", "lang", "languages", "segments"]
    assert {(r.doc_id, r.lang) for r in got.collect()} == {(r.doc_id, r.lang) for r in df.collect()}


def test_repair():
    assert repaired("férias é".encode().decode("latin-1")) == "férias é"
    assert repaired("naïve café") == "naïve café"


def test_pattern_is_the_vocabularys():
    text = "It's 3 o'clock… Zoë's  tea\n\n"
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert t.encode(text, add_special_tokens=False).ids == SMALL.encode(text)
    assert isinstance(SMALL.encoding, tiktoken.Encoding)


def test_text_functions_on_columns(rows):
    df = rows([(1, "a b"), (2, None)], "k int, t string")
    assert tuples(encode_corpus(df, key="k", text="t").select("k", F.size("ids"))) == [(1, 2), (2, 0)]
