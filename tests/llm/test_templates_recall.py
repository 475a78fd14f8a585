"""Items that were copied as they are, in other case, or with numbers, names and units exchanged."""

import random
import re

from loomspark.llm import templates

VERBS = "buys sells carries finds moves counts sorts paints brings stores".split()
NOUNS = "apples pears boxes chairs stones bottles coins ribbons lamps ropes plates candles".split()
PLACES = "market harbour station garden school bridge village workshop".split()
NAMES = "Alice Bob Carla Dmitri Erik Fatima NASA ESA Grete Hugo Ines Zoë".split()


def item(rng):
    name, other = rng.sample(NAMES, 2)
    return f"{name} {rng.choice(VERBS)} {rng.randrange(2, 60)} red {rng.choice(NOUNS)} and {rng.randrange(2, 60)} {rng.choice(NOUNS)} " + rng.choice(
        ["", f"near the old {rng.choice(PLACES)}", f"then walks {rng.randrange(2, 90)} km to meet {other} at the {rng.choice(PLACES)}. How many {rng.choice(NOUNS)} are left in the end?"]
    )


def changed(text, rng):
    """Other numbers, names and units, each by one new value throughout."""
    names = dict(zip(NAMES, rng.sample([f"Q{c}ra" for c in "abcdefghijkl"], len(NAMES)), strict=True))
    numbers = {}
    text = re.sub(r"\d+", lambda m: numbers.setdefault(m[0], str(100 + 7 * len(numbers))), text)
    return re.sub("|".join(NAMES), lambda m: names[m[0]], text).replace(" km ", " miles ").replace(" miles ", " mi ")


def test_recall_of_changed_and_copied_items(spark):
    rng = random.Random(5)
    items = [item(rng).strip() for _ in range(60)] + ["What is 17 + 25?", "12 13 14 15 16 17 18 19 20", "Name the five oceans", "too short 3"]
    noise = lambda n: " ".join(rng.choice("of grey rain over quiet hills some people talk about their long day".split()) for _ in range(n))
    docs, want = [], {}
    for i, text in enumerate(items):
        for kind, put in enumerate((text, text.lower(), text.upper(), changed(text, rng))):
            if i == 63 or kind == 3 and i >= 60:
                continue
            docs.append((len(docs), f"{noise(5)}{rng.choice([', ', ' ', '. '])}{put} {noise(6)}"))
            want[len(docs) - 1] = (i, kind)
    clean = [(10_000 + k, noise(40)) for k in range(60)]
    found = {(r.doc_id, r.item_id) for r in templates.leaks(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for kind in range(4):
        asked = [(d, i) for d, (i, k) in want.items() if k == kind]
        caught = sum(x in found for x in asked) / len(asked)
        assert caught >= (1.0 if kind < 3 else 0.9), (kind, caught, [items[i] for d, i in asked if (d, i) not in found][:5])
    assert not {d for d, _ in found} & {d for d, _ in clean}


def test_recall_of_the_given_items_with_slots_exchanged(spark):
    """The items of the given table, each name and number replaced by one new value throughout."""
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs, n_exchanged = [], 0
    for item_id, text in items:
        new: dict[str, str] = {}

        def value(m):
            word = m[0]
            if word.lower() in templates.FUNCTION_WORDS:
                return word
            return new.setdefault(word.lower(), str(500 + len(new)) if word[0].isdigit() else f"Q{'abcdefghij'[len(new) % 10]}{'xyz'[len(new) // 10 % 3]}")  # noqa: B023

        put = re.sub(r"\d+|\b[^\W\d_a-z]\w*", lambda m: value(m) if m[0][0].isdigit() or m[0][0].isupper() else m[0], text)
        n_exchanged += len(new)
        docs.append((item_id, f"some words before, {put} and {rng.randrange(9)} words after"))
    found = {(r.doc_id, r.item_id) for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    caught = sum((i, i) in found for i, _ in items) / len(items)
    assert n_exchanged > len(items) and caught >= 0.9, (n_exchanged, caught)
    assert all(a == b for a, b in found)


def plain_windows(text):
    """What one text matches by: (at, template) and (at, words) of all windows."""
    raw = re.findall(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+", text)
    tpl = []
    for k, t in enumerate(raw):
        low = t.lower()
        if t[0].isdigit():
            tpl.append("0")
        elif k and raw[k - 1][0].isdigit() and low in templates.UNITS:
            tpl.append("2")
        else:
            tpl.append("1" if t[0] != t[0].lower() and low not in templates.FUNCTION_WORDS else low)
    return raw, tpl


def plain_leak(text, given):
    """The rule itself: enough windows of one alignment, equal word for word or with slots that agree."""
    (raw, tpl), (words, want) = plain_windows(text), plain_windows(given)
    if len(words) < 4:
        return False
    size = 8 if len(words) >= 8 else 4
    usable = {}
    for at in range(len(words) - size + 1):
        many = sum(not t.isdigit() for t in want[at : at + size])
        usable[at] = many >= templates.LEAST_WORDS[size]
    need = min(3, len(usable)) if size == 8 else len(usable)
    for shift in range(-len(words), len(raw)):
        hit, equal, slots = 0, 0, set()
        for at, by_template in usable.items():
            here = at + shift
            if here < 0 or here + size > len(raw):
                continue
            same = [x.lower() for x in raw[here : here + size]] == [x.lower() for x in words[at : at + size]]
            if same or by_template and tpl[here : here + size] == want[at : at + size]:
                hit, equal = hit + 1, equal + same
                slots |= {(t, a.lower(), b.lower()) for t, a, b in zip(want[at : at + size], words[at : at + size], raw[here : here + size], strict=True) if t in "012"}
        if equal >= need or hit >= need and len(slots) == len({s[:2] for s in slots}):
            return True
    return False


def test_leaks_like_brute_force(spark):
    rng = random.Random(11)
    items = [item(rng).strip() for _ in range(12)] + ["What is 17 + 25?", "take 5 apples then take 5 pears then take 5 plums and go"]
    docs = []
    for text in items:
        w = text.split()
        for _ in range(6):
            part = [*w]
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = rng.choice(["7", "Otto", "grey", "km", *w])
            docs.append((len(docs), " ".join([*rng.choices(w, k=3), *part[rng.randrange(3) :], *rng.choices(w, k=3)])))
    got = {(r.doc_id, r.item_id) for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {(d, i) for d, text in docs for i, given in enumerate(items) if plain_leak(text, given)}
    assert got == want and 10 < len(want) < len(docs) * 3
