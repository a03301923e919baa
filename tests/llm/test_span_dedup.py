import random
import time

import helpers
import pytest

from gigsift.llm import span_dedup as op


def brute(rows):
    """Sentences to remove by document, and their kept text."""
    first, again = {}, {}
    for doc_id, text in rows:
        places = op.sentences(text or "")
        words = [text[a:b].lower().split() for a, b in places]
        for at, size in ((at, size) for at in range(len(places)) for size in (op.RUN - 1, op.RUN)):
            size = min(size, len(places))
            run = tuple(" ".join(w) for w in words[at:at + size])
            least = op.LEAST_WORDS if size == min(op.RUN, len(places)) else op.ENOUGH_WORDS
            if len(run) == size and sum(map(len, words[at:at + size])) >= least and first.setdefault(run, (doc_id, at)) != (doc_id, at):
                again.setdefault(doc_id, set()).update(range(at, at + size))
    return again


def covered(spans, texts):
    found = {}
    for row in spans:
        places = op.sentences(texts[row.doc_id])
        inside = {i for i, (a, b) in enumerate(places) if row.start <= a and b <= row.end}
        assert len(inside) == row.n_sentences and not inside & found.get(row.doc_id, set())
        found.setdefault(row.doc_id, set()).update(inside)
    return found


def corpus():
    sentence = lambda i, n=9: helpers.words(i, n, 5000).capitalize() + "."
    passage = " ".join(sentence(900 + i) for i in range(7))
    texts = [" ".join([*(sentence(10 * i + k) for k in range(4)), passage if i % 3 == 0 else "", *(sentence(10 * i + k) for k in range(4, 8))]) for i in range(30)]
    texts += [texts[1], texts[2].upper(), texts[4].replace(". ", ".\n\n"), "Ok. Yes. No.", "Ok. Yes. No.", helpers.words(77, 40), helpers.words(77, 40),
              " ".join([sentence(5), sentence(6), sentence(7)] * 3), None, ""]
    return texts


def test_matches_brute_force(spark):
    texts = corpus()
    spans = op.repeated_spans(helpers.table(spark, texts)).collect()
    assert covered(spans, texts) == brute(list(enumerate(texts)))
    clean = {i for i in range(30) if i % 3 and i not in (0,)}
    assert not clean & {r.doc_id for r in spans} and {r.first_doc_id for r in spans if r.doc_id in (3, 27)} == {0}


def test_what_is_left_of_the_texts(spark):
    texts = corpus()
    docs = helpers.table(spark, texts)
    kept = {r.doc_id: r.text for r in op.without_repeats(docs).collect()}
    gone = brute(list(enumerate(texts)))
    for i, text in enumerate(texts):
        if i not in gone:
            assert kept[i] == text
        else:
            left = [text[a:b] for k, (a, b) in enumerate(op.sentences(text)) if k not in gone[i]]
            assert kept[i].split() == " ".join(left).split()
    assert op.without_repeats(docs).columns == docs.columns


def test_odd_rows(spark):
    docs = helpers.odd(spark)
    spans = op.repeated_spans(docs).collect()
    assert [(r.doc_id, r.first_doc_id, r.start) for r in spans] == [(4, 4, 0)] and op.repeated_spans(helpers.none(spark)).count() == 0
    left = op.without_repeats(docs)
    assert left.columns == docs.columns and op.without_repeats(helpers.none(spark)).count() == 0
    before, after = (sorted(map(str, (r.text for r in d.collect()))) for d in (docs, left))
    gone = [t for t in before if len(t) > 1000]
    assert len(gone) == 2 and sorted([*after, gone[0]]) == sorted([*before, ""])


def test_rows_of_one_id_are_cut_by_their_own_places(spark):
    shared, other = helpers.words(1, 60, 9000), helpers.words(2, 60, 9000)
    rows = [(1, f"{shared}\n{other}"), (7, shared), (7, helpers.words(3, 90, 9000)), (None, other), (None, helpers.words(4, 30, 9000))]
    left = op.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in left) == sorted(["", shared + "\n", rows[2][1], rows[3][1], rows[4][1]])


def test_passages_are_found_at_any_offset(spark):
    """Against windows of words, which know nothing of sentences: long passages are found, and what goes occurs elsewhere."""
    draw, texts, inside = random.Random(8), [], []
    passages = [[f"p{draw.randrange(20_000)}" + ("." if i % 2 and draw.random() < 0.08 else "") for _ in range(55 + 5 * i)] for i in range(12)]
    for i in range(72):
        mine = lambda: [f"u{i}x{draw.randrange(10_000)}" + ("." if draw.random() < 0.05 * (i % 3) else "") for _ in range(draw.randrange(80))]
        lead = mine()
        texts.append(" ".join([*lead, *(passages[i % 18] if i % 18 < 12 else []), *mine()]))
        inside.append((len(lead), len(lead) + len(passages[i % 18])) if i % 18 < 12 else (0, 0))
    gone = {}
    for r in op.repeated_spans(helpers.table(spark, texts)).collect():
        before = len(texts[r.doc_id][:r.start].split())
        gone.setdefault(r.doc_id, set()).update(range(before, before + len(texts[r.doc_id][r.start:r.end].split())))
    assert set(gone) == {i for i in range(18, 72) if i % 18 < 12}
    assert all(min(at) >= inside[i][0] and max(at) < inside[i][1] for i, at in gone.items())
    assert sum(map(len, gone.values())) > 0.75 * sum(b - a for i, (a, b) in enumerate(inside) if i >= 18)


@pytest.mark.parametrize("text", [" " * 10_000_000, "\n" * 1_000_000, "no stop " * 200_000, ". " * 200_000, "Ok.  \n" * 200_000])
def test_work_is_linear_in_the_text(text):
    begin = time.perf_counter()
    op.runs_of(text)
    assert time.perf_counter() - begin < 5


@pytest.mark.parametrize("text,expected", [
    ("One. Two!\n\nThree", ["One.", "Two!", "Three"]), ("v1.2 is out. Go", ["v1.2 is out.", "Go"]), ("一。二！三", ["一。", "二！", "三"]), (" \n ", [])])
def test_sentences(text, expected):
    assert [text[a:b] for a, b in op.sentences(text)] == expected


def test_sentences_cut_together_are_cut_like_each_alone():
    draw = random.Random(9)
    long = [[f"w{draw.randrange(50)}" for _ in range(draw.choice((17, 40, 90, 300)))] for _ in range(40)] + [["same"] * 100]
    together = op.cuts(long)
    assert together == [op.cuts([words])[0] for words in long]
    for words, found in zip(long, together):
        assert found[0] == 0 and found[-1] == len(words) and all(0 < b - a <= 2 * op.LONGEST for a, b in zip(found, found[1:]))
    text = " ".join(" ".join(words) + ("." if i % 2 else "  \u0130I.") for i, words in enumerate(long))
    for start, end, words in op.sentences_and_words(text):
        assert text[start:end].lower().split() == words and text[start:end] == text[start:end].strip()
