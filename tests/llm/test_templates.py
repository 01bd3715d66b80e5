"""Operator 5 on planted passages and re-parameterised questions."""

import random
import re

import pytest

from fluxbook.llm.templates import decontaminate

QUESTION = "A farmer named Alice sells 12 boxes of pears every day and each box weighs 3 kg, so how many kg of pears does Alice sell in 7 days?"
OTHER = QUESTION.replace("Alice", "Bertha").replace("12", "45").replace(" 3 kg", " 8 lb").replace("many kg", "many lb").replace("7", "9")
TORN = QUESTION.replace("does Alice", "does Carola")
PLAIN = "the quick wooden bridge over the narrow river was built by local people long before any road had reached the village at all"
FILLER = "nothing in this text has anything to do with what was asked there and so it goes on for some while without any question in it"
ITEMS = [(1, QUESTION), (2, PLAIN), (3, None), (4, ""), (5, "short one here now ok"), (6, "7 8 9")]
ITEM_SCHEMA = "item_id long, text string, id int, window int"


def judged(frame, texts, items=ITEMS):
    docs = frame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, row int, item int")
    out = {}
    for r in decontaminate(docs, frame([(*i, 1, 2) for i in items], ITEM_SCHEMA)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert all(len(v) == 1 for v in out.values())
    return [out[i][0] for i in range(len(texts))]


@pytest.mark.parametrize("text, held, same", [
    (QUESTION, 1, True), (f"{FILLER}. {QUESTION} {FILLER}", 1, True), (OTHER, 1, False), (f"{FILLER}. {OTHER} {FILLER}", 1, False),
    (QUESTION.upper(), 1, True), (PLAIN, 2, True), (f"{FILLER} {PLAIN} {FILLER}", 2, True), ("Short one, here now: OK!", 5, True),
])
def test_finds(frame, text, held, same):
    found = judged(frame, [text])[0]
    assert (found["contaminated"], found["item"], found["n_items"], found["same_slots"]) == (True, held, 1, same)


def test_slots_must_be_consistent(frame):
    """Where an item's name stands for two names of the text, the windows with that name do not count, the others do."""
    whole, torn = judged(frame, [OTHER, TORN])
    assert whole["matched"] > torn["matched"] > 0
    names = "now Alice met Bertha and Alice saw Bertha then Alice fed Bertha so Alice met Bertha"
    turned = "now Alice met Bertha and Carola saw Dora then Emma fed Fritz so Gerda met Hanna"
    same, other = judged(frame, [names.replace("Alice", "Ina").replace("Bertha", "Jana"), turned], [(1, names)])
    assert same["contaminated"] and not same["same_slots"] and not other["contaminated"]


def test_one_changed_number_hides_no_copy(frame):
    passage = PLAIN + " with 40 oxen and again 40 oxen at the end of a long and very dry summer"
    for text in (passage, passage.replace("40", "41", 1)):
        found = judged(frame, [f"{FILLER} {text} {FILLER}"], [(1, passage)])[0]
        assert found["contaminated"]


def test_items_of_placeholders_only(frame):
    """Windows with hardly a plain word are held by their own values: an exact copy is found, one with other values is not."""
    sums = "12 + 7 = 19 34 + 8 = 42 5 + 6 = 11 70 + 1 = 71 9 + 9 = 18"
    exact, other, short = judged(frame, [f"{FILLER} {sums}", f"{FILLER} {sums.replace('7', '3')}", "12 + 7 = 19"], [(1, sums), (2, "12 + 7 = 19")])
    assert exact["contaminated"] and exact["item"] == 1 and not other["contaminated"] and not short["contaminated"]


def brute(texts, items):
    """Contaminated or not, by loops, for texts of small words and numbers."""
    def listed(text):
        words = re.findall(r"[a-z]+|[0-9]+(?:[.,][0-9]+)*", text or "")
        out = []
        for i in range(len(words) - 7):
            own = words[i:i + 8]
            numbers = [w for w in own if w[0].isdigit()]
            out.append((tuple("#" if w[0].isdigit() else w for w in own), numbers) if len(numbers) <= 4 else (("as is", *own), []))
        return out

    found = []
    held_items = [w for w in map(listed, items) if w]
    for text in texts:
        own, hit = listed(text), False
        for item in held_items:
            shifts = {}
            for place, (key, numbers) in enumerate(own):
                for at, (wanted, values) in enumerate(item):
                    if key == wanted:
                        shifts.setdefault(place - at, []).append((at, list(zip(numbers, values))))
            matched = set()
            for windows in shifts.values():
                pairs = {p for _, ps in windows for p in ps}
                bad = {p for p in pairs if any((p[0] == q[0]) != (p[1] == q[1]) for q in pairs)}
                matched |= {at for at, ps in windows if not bad & set(ps)}
            hit |= bool(matched) and (len(matched) >= 6 or len(matched) >= 0.5 * len(item))
        found.append(hit)
    return found


def test_by_loops(frame):
    rng = random.Random(6)
    words = ["ab", "cd", "ef", "gh"]
    line = lambda n, numbers: " ".join(rng.choice(words) if rng.random() > numbers else str(rng.randrange(3)) for _ in range(n))
    items = [line(rng.randint(8, 16), rng.choice([0.2, 0.5, 0.9])) for _ in range(12)]
    texts = []
    for _ in range(150):
        tokens = rng.choice(items).split()
        a = rng.randrange(3)
        part = tokens[a:a + rng.randint(8, 16)]
        other = dict(zip("012", rng.sample("0123456", 3))) if rng.random() < 0.4 else {}
        part = [str(rng.randrange(3)) if w.isdigit() and rng.random() < 0.05 else other.get(w, w) for w in part]
        if rng.random() < 0.2:
            part[rng.randrange(len(part))] = rng.choice(words)
        texts.append(" ".join([line(5, 0.5), *part, line(5, 0.5)]))
    wanted = brute(texts, items)
    assert 20 < sum(wanted) < 140
    assert [r["contaminated"] for r in judged(frame, texts, list(enumerate(items)))] == wanted


def test_leaves_clean_texts(frame):
    texts = [FILLER, None, "", " ", "7 8 9", "12 kg 13 kg 14 kg 15 kg 16 kg 17 kg 18 kg 19 kg", "how many kg of pears does", FILLER * 400]
    assert not any(r["contaminated"] for r in judged(frame, texts))


def test_repeated_rows_empty_tables_and_passes(frame, no_documents):
    docs = frame([(1, QUESTION), (1, QUESTION), (None, QUESTION), (None, None)], "doc_id long, text string")
    items = frame(ITEMS, "item_id long, text string")
    found = decontaminate(docs, items).collect()
    assert sorted(r["contaminated"] for r in found) == [False, True, True, True]
    assert decontaminate(no_documents, items).collect() == []
    assert not any(r["contaminated"] for r in decontaminate(docs, items.limit(0)).collect())


def test_several_passes_give_the_same(frame):
    from fluxbook.llm.templates import TemplateSettings

    docs = frame([(i, t) for i, t in enumerate([QUESTION, OTHER, PLAIN, FILLER, None])], "doc_id long, text string")
    items = frame(ITEMS, "item_id long, text string")
    key = lambda df: sorted((r["doc_id"], r["contaminated"], r["item"], r["matched"]) for r in df.collect())
    assert key(decontaminate(docs, items)) == key(decontaminate(docs, items, settings=TemplateSettings(block=7)))
