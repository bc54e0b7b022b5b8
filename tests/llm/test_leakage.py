import math
import random
from collections import Counter

import pytest

import oracle
from tidemark.llm import leakage, queries
from tidemark.sources.tables import table

RND = random.Random(11)
NAMES = ["".join(RND.choice(["ba", "ko", "ru", "ze", "mi"]) for _ in range(3)) + str(i) for i in range(4000)]


def sentence(rnd):
    n = lambda: rnd.choice(NAMES)
    k = lambda: str(rnd.randrange(10, 9999))
    return rnd.choice([f"According to the ledger of {n()}, exactly {k()} returns came from {n()} while {k()} were never claimed.", f"A courier of {n()} starts with {k()} parcels, drops {k()} at {n()} and collects {k()} more near {n()}.", f"Compute the fee owed to {n()} when {k()} transfers at {k()} cents each precede {k()} reversals."])


def item(seed):
    rnd = random.Random(seed)
    return "Question: " + " ".join(sentence(rnd) for _ in range(4))


def edited(text, rnd, share=1 / 8):
    ws = text.split()
    for i in range(0, len(ws) - 8, 8):
        at = i + rnd.randrange(8)
        ws[at] = rnd.choice(["", "indeed", ws[at] + " so"])
    return " ".join(ws)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, row long")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc string")
    return sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(d, "doc_id", "text", i, "item_id", "text").collect())


ITEMS = [(i, item(i)) for i in range(30)]
FILL = "The clerk weighed the parcel and wrote a long note about the weather in the yard that day. "


def test_whole_part_pieces_and_edits(spark):
    rnd = random.Random(1)
    whole = dict(ITEMS)
    words = whole[3].split()
    docs = [
        (1, FILL + whole[1] + FILL),
        (2, FILL + " ".join(whole[2].split()[20:60]) + FILL),
        (3, FILL + " ".join(words[:18]) + " " + FILL * 3 + " ".join(words[30:50])),
        (4, FILL + edited(whole[4], rnd) + FILL),
        (5, "<p>" + whole[5].upper().replace(",", " -").replace(" ", "​ <b></b>", 30) + "</p>"),
        # Not cases: other names and numbers, a short passage, the item's pieces in the wrong order.
        (6, FILL + item(999)),
        (7, FILL + " ".join(whole[7].split()[:12]) + FILL),
        (8, FILL + " ".join(whole[8].split()[48:62]) + " " + FILL * 2 + " ".join(whole[8].split()[:14])),
        (9, None),
        (10, ""),
        (11, "  \n"),
        (12, whole[12]),
        (12, whole[12]),
        (None, whole[13]),
        (14, (FILL * 400) + whole[14]),
    ]
    assert run(spark, docs, ITEMS) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (12, 12), (14, 14)]


def test_empty_sides_and_short_items(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, ITEMS[0][1])], []) == []
    assert run(spark, [(1, "one two four")], [(1, "one two three"), (2, None), (3, ""), (None, ITEMS[0][1])]) == []
    assert run(spark, [(None, "one two three"), (2, None)], [(1, "one two three")]) == []


def test_items_of_few_words_are_held_word_for_word(spark):
    items = [(1, "Seven herons"), (2, "when did the heron leave"), (3, "Lisbon"), (4, "which heron was it")]
    docs = [(1, FILL + "SEVEN-herons " + FILL), (2, FILL + "When did the heron leave? " + FILL), (3, FILL + "when did a heron leave"), (4, "lisbon"), (5, "seven grey herons"), (6, FILL + " which heron was it")]
    assert run(spark, docs, items) == [(1, 1), (2, 2), (4, 3), (6, 4)]


def test_an_item_under_several_ids(spark):
    text = ITEMS[0][1]
    items = [(100, text), (101, text.upper()), (102, text.replace(" ", "  ")), *ITEMS[1:]]
    docs = [(1, text), (2, FILL + text + FILL), (3, FILL + item(998)), (4, edited(text, random.Random(2)))]
    assert run(spark, docs, items) == [(d, i) for d in (1, 2, 4) for i in (100, 101, 102)]


def test_a_word_of_few_texts_among_many(spark):
    # Each name stands in four of 600 item texts, fewer than one in a hundred.
    rnd = random.Random(6)
    names = [f"zu{i}ka" for i in range(450)]
    drawn = [rnd.sample(names, 450) for _ in range(4)]
    order = [n for d in drawn for n in d]
    items = [(i, "the keeper of {} tells the keeper of {} that no boat of {} may pass the weir by night".format(*order[3 * i : 3 * i + 3])) for i in range(600)]
    docs = [(1, FILL + items[5][1] + FILL), (2, FILL + "the keeper of one tells the keeper of another that no boat of nobody may pass the weir by night " + FILL)]
    found = run(spark, docs, items)
    # Another item may share a stretch and the names in it.
    assert (1, 5) in found and 2 not in {d for d, _ in found}


def test_passes_and_shuffled_items_give_the_same(spark, monkeypatch):
    whole = dict(ITEMS)
    docs = [(i, FILL + whole[i] + FILL) for i in range(0, 30, 3)] + [(100, FILL)]
    want = [(i, i) for i in range(0, 30, 3)]
    monkeypatch.setattr(leakage, "SENT_SHINGLES", 0)
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 4)
    assert run(spark, docs, ITEMS) == want
    monkeypatch.setattr(leakage, "AT_ONCE", 600)
    assert run(spark, docs, ITEMS) == want


def test_an_item_in_a_third_of_all_documents(spark):
    docs = [(i, FILL + (ITEMS[0][1] if i % 3 == 0 else FILL * 2)) for i in range(300)]
    assert run(spark, docs, ITEMS) == [(i, 0) for i in range(0, 300, 3)]


def fits(item, doc, start, stop):
    """Fewest edits of item[start:stop] against any stretch of the document, for each start, by Sellers' recurrence; with where it ends."""
    m = len(doc)
    row = [0] * (m + 1)
    for i in range(start, stop):
        new = [i - start + 1] + [0] * m
        for j in range(1, m + 1):
            new[j] = min(row[j - 1] + (item[i] != doc[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        yield i + 1, min(row)


def brute(item, doc, share, edits):
    """Whether one stretch, or two apart, of at least ``share`` of the item's words stand in the document with so many edits a word.

    Written from the statement of the problem alone. Where the stretches stand is not looked at, so it asks a little less than the order.
    """
    n = len(item)
    best = {}
    for i in range(n):
        for j, e in fits(item, doc, i, n):
            if j - i >= 5 and e <= edits * n:
                best[i, j] = e
    one = [(i, j, e) for (i, j), e in best.items() if e <= edits * (j - i)]
    if any(j - i >= share * n for i, j, _ in one):
        return True
    loose = [(i, j, e) for (i, j), e in best.items()]
    return any(j <= x and (j - i) + (y - x) >= share * n and e + f <= edits * ((j - i) + (y - x)) for i, j, e in one for x, y, f in loose) or any(j <= x and (j - i) + (y - x) >= share * n and e + f <= edits * ((j - i) + (y - x)) for i, j, e in loose for x, y, f in one)


def test_against_edit_distances_of_all_stretches(spark):
    rnd = random.Random(23)
    common = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.sample(common, 24))) for i in range(12)]
    docs, whole = [], dict(items)
    for d in range(150):
        ws = whole[rnd.randrange(12)].split()
        parts = []
        for _ in range(rnd.choice([1, 1, 2])):
            size = rnd.randrange(4, 16)
            at = rnd.randrange(len(ws) - size + 1)
            piece_ = ws[at : at + size]
            for _ in range(rnd.randrange(0, 3)):
                k = rnd.randrange(len(piece_))
                piece_[k : k + 1] = rnd.choice([["zz"], [], [piece_[k], "yy"]])
            parts += [*piece_, *rnd.sample(["fill", "other", "more", "text"], 3)]
        docs.append((d, " ".join(parts)))
    found = set(run(spark, docs, items))
    for d, text in docs:
        for i, ws in items:
            if len(set(text.split()) & set(ws.split())) < 4:
                assert (d, i) not in found
            elif brute(ws.split(), text.split(), 0.4, 1 / 8) and in_order(ws.split(), text.split()):
                assert (d, i) in found, (text, ws)
            elif not brute(ws.split(), text.split(), leakage.COVER, 1 / 5):
                assert (d, i) not in found, (text, ws)


def in_order(item, doc):
    """Whether the item's words, all different, stand in the document in their order."""
    places = [item.index(w) for w in doc if w in item]
    return places == sorted(places)


def test_query(spark):
    got = queries.p9_found(spark, f"{oracle.DATA}/sf0.001")
    assert got.columns == ["doc_id", "item_id"] and got.count() == got.distinct().count() > 0


def test_hashes_agree_with_words(spark):
    rnd = random.Random(3)
    odd = "aZ09 -\n\u00ad\u0301éßﬁ½ǅ가Ω\u200b_'<b>&amp;\u2028\x1e中ñÇ²"
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(80))) for _ in range(500)] + [None, "", " ", "a" * 300_000, "x y " * 60_000]
    texts += [r.text for r in table(spark, f"{oracle.DATA}/sf0.001", "documents").select("text").collect()]
    h, bounds = leakage.tokens(texts)
    seen, back = {}, {}
    for i, t in enumerate(texts):
        own = h[bounds[i] : bounds[i + 1]].tolist()
        ws = leakage.words(t)
        assert len(own) == len(ws), t
        for w, x in zip(ws, own):
            assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w, (w, t)


def test_words():
    assert leakage.words("<p>Ação <b>SO</b>­ft&amp;​É ﬁne</p>x<br>y") == ["acao", "soft", "e", "fine", "x", "y"]
    assert leakage.words("Acc-\nording to re-<br>turns\n> and unl- \n> oads, well-known") == ["according", "to", "returns", "and", "unloads", "well", "known"]
    assert leakage.words(None) == []


def piece(ws, rnd, at_ends):
    """One word in eight changed, added or dropped; next to the ends, beside one another, or anywhere."""
    n = len(ws) // 8
    at = rnd.sample(range(1, len(ws) - 1), n) if at_ends is None else [1, len(ws) - 2, 3][:n] if at_ends else list(range(len(ws) // 2, len(ws) // 2 + n))
    out = list(ws)
    for i in sorted(at, reverse=True):
        out[i : i + 1] = rnd.choice([["indeed"], [], [ws[i], "so"]])
    return out


@pytest.mark.parametrize("at_ends", [True, False, None])
def test_edited_pieces_at_two_fifths_to_a_half(spark, at_ends):
    rnd = random.Random(7)
    docs, truth = [], []
    for i, text in ITEMS:
        ws = leakage.words(text)
        for share in (0.4, 0.45, 0.5):
            total = math.ceil(share * len(ws))
            one = rnd.randrange(int(0.4 * total), int(0.6 * total) + 1)
            start = rnd.randrange(len(ws) - total)
            second = rnd.randrange(start + one + 1, len(ws) - total + one + 1)
            doc = len(docs)
            docs.append((doc, " ".join([FILL, *piece(ws[start : start + one], rnd, at_ends), FILL * 2, *piece(ws[second : second + total - one], rnd, at_ends), FILL])))
            truth.append((doc, i))
    assert run(spark, docs, ITEMS) == truth


def test_passages_do_not_cross_left_out_text():
    ws = leakage.words(ITEMS[0][1])
    n = len(ws) // 6
    known = leakage._Item(leakage.tokens([" ".join(ws)])[0], leakage.np.arange(len(ws)))
    parts = [known.numbers[i * 2 * n : i * 2 * n + n - 1] for i in range(3)]
    gap = leakage.np.array([leakage.GAP], leakage.np.int32)
    b = leakage.np.concatenate([x for p in parts for x in (gap, p)])
    assert all(not leakage._judged(leakage._Blocks(known.numbers, b, penalty), known) for penalty in leakage.PENALTIES)


def test_blocks_of_a_long_text_are_as_one(monkeypatch):
    rnd = random.Random(9)
    np = leakage.np
    for _ in range(40):
        n, m = rnd.randrange(5, 40), rnd.randrange(70, 300)
        a = np.array([rnd.randrange(30) for _ in range(n)], np.int32)
        b = np.array([rnd.choice([-1, leakage.GAP, *a[: n // 2 + 1]]) for _ in range(m)], np.int32)
        at = rnd.randrange(m - 5)
        b[at : at + n] = a[: len(b[at : at + n])]
        for penalty in leakage.PENALTIES:
            whole = leakage._Blocks(a, b, penalty)
            monkeypatch.setattr(leakage, "CELLS", 1)
            cut = leakage._Blocks(a, b, penalty)
            monkeypatch.undo()
            assert len(cut.borders) > 2 and cut.score == whole.score and cut.passages() == whole.passages()
            kept = np.zeros((3, n + 1, m + 1, 1), np.int32)
            best = leakage._reach(a[None], np.zeros((1, n), np.int32), b[None], penalty, 0, kept)
            assert best[0] == whole.score and all((k[:, :, 0] == t).all() for k, t in zip(kept, whole.tables(0)))


def test_names_and_numbers_of_both_passages_together(spark):
    # The first half has no name and no number, the second one name and short numbers only.
    plain = "whoever keeps the small register shall copy every line of it before the clerk returns from the market in the evening"
    text = f"{plain} while the guild of Zerumi counted 7 crates and 12 barrels and the rest of the yard stayed empty until morning came"
    ws = text.split()
    others = [(101, text.replace("Zerumi", "Kobaru").replace("7", "3").replace("12", "40")), (102, text.replace("Zerumi", "Miruko").replace("7", "9").replace("12", "55"))]
    docs = [
        (1, " ".join([FILL, *ws[:12], FILL * 2, *ws[24:34], FILL])),
        (2, " ".join([FILL, *ws[2:20], FILL])),
        # The passage of all three items; the one name is the edited word, numbers stay; and other name and numbers, a sentence of the same form.
        (3, " ".join([FILL, *ws[18:38], FILL]).replace("Zerumi", "somebody")),
        (4, " ".join([FILL, *ws[20:38], FILL]).replace("Zerumi", "Kobaze").replace("7", "4").replace("12", "31")),
    ]
    assert run(spark, docs, [(100, text), *others]) == [(1, 100), (2, 100), (2, 101), (2, 102), (3, 100)]
    # An item under three ids, in which there is no name or number.
    assert run(spark, [(1, FILL + plain + FILL)], [(i, plain) for i in range(3)]) == [(1, 0), (1, 1), (1, 2)]


def test_filters_lose_nothing(spark):
    # Every item against every whole document, without prefix or bounds.
    root = f"{oracle.DATA}/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, root, "documents").select("doc_id", "text").collect() if r.text and len(r.text) < 3000]
    items = [(r.item_id, leakage.words(r.text), r.text) for r in table(spark, root, "eval_items").orderBy("item_id").limit(60).collect()]
    counted = Counter(w for _, ws, _ in items for w in set(ws))
    distinct = {w for w, n in counted.items() if n <= 2}
    known = {i: leakage._Item(leakage.tokens([" ".join(ws)])[0], leakage.np.array([k for k, w in enumerate(ws) if w in distinct or w.isdigit()])) for i, ws, _ in items}
    want = []
    for d, t in docs:
        h = leakage.tokens([t])[0]
        for i, one in known.items():
            if len(set(one.h.tolist()) & set(h.tolist())) < 6:
                continue
            at = leakage.np.minimum(leakage.np.searchsorted(one.known, h), len(one.known) - 1)
            b = leakage.np.where(one.known[at] == h, at, -1).astype(leakage.np.int32)
            for penalty in leakage.PENALTIES:
                verdict = leakage._judged(leakage._Blocks(one.numbers, b, penalty), one)
                if verdict is not None:
                    want += [(d, i)] * verdict
                    break
    assert want and run(spark, docs, [(i, t) for i, _, t in items]) == sorted(want)


def test_edited_pieces_far_apart_in_long_texts(spark):
    items = [(i, " ".join(ws)) for i, t in ITEMS if len(ws := leakage.words(t)[:60]) == 60]
    docs = []
    for i, t in items:
        ws = t.split()
        one, two = ws[3:15], ws[40:52]
        one[6], two[5] = "indeed", "indeed"
        docs.append((i, " ".join([FILL, *one, FILL * 60, *two, FILL])))
    assert items and run(spark, docs, items) == [(i, i) for i, _ in items]
