import random
import re

from keyloom.llm.decontaminate import decontaminate, without_contaminated


def verdicts(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = {}
    for r in decontaminate(d, b, **how).collect():
        out.setdefault(r.doc_id, []).append((r.contaminated, r.item_id))
    return out


def brute(docs, items):
    """Containment of windows of five lower-cased words, for texts without numbers, names or units."""
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = {}
    for i, t in docs:
        have = set(grams(t))
        best = min(((-sum(g in have for g in q) / len(q), k) for k, x in items if (q := grams(x))), default=(0, None))
        out[i] = [(True, best[1])] if best[0] <= -0.8 else [(False, None)]
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.randint(4, 40)))) for i in range(30)]
    docs = [(1, None), (2, ""), (3, "few words")]
    for i in range(10, 120):
        t = [word() for _ in range(r.randint(0, 100))]
        if r.random() < 0.5:
            p = r.choice(items)[1].split()
            if r.random() < 0.5:
                p[r.randrange(len(p))] = word()
            t[len(t) // 2 : len(t) // 2] = p
        docs.append((i, ", ".join(t)))
    assert verdicts(spark, docs, items) == brute(docs, items)


def test_templates_and_slots(spark):
    item = "a train leaves with Anna at 40 km per hour and meets Bob after 3 hours when 40 people and Bob get off"
    items = [(7, item)]
    other = item.replace("Anna", "Clara").replace("Bob", "Dora").replace("40", "65").replace("after 3", "after 9")
    mixed = item.replace("Anna", "Clara").replace("meets Bob", "meets Dora").replace("at 40 km", "at 65 mm").replace("Bob get", "Emil get")
    docs = [(1, f"so it goes: {item}. and on"), (2, f"so, {other}"), (3, f"so, {mixed}"), (4, "1 2 3 4 5 6 7 8 9 10 " * 5), (None, item), (5, item), (5, item)]
    got = verdicts(spark, docs, items)
    assert got[1] == got[2] == got[None] == [(True, 7)] and got[5] == [(True, 7)] * 2
    assert got[3] == got[4] == [(False, None)]


def test_empty(spark):
    docs = [(1, "one two three four five six")]
    assert verdicts(spark, docs, []) == {1: [(False, None)]}
    assert verdicts(spark, [], [(1, "one two three four five six")]) == {}
    assert verdicts(spark, docs, [(1, None), (2, "one two"), (None, "one two three four five six")]) == {1: [(True, None)]}


FIRST, LAST = "Anna Bob Clara David Elena Farid Greta Hugo".split(), "Smith Jones Okafor Lind Weber".split()
FILLER = "apples pears boxes then gives takes away some of them and walks home with the rest while another friend counts every item on the long table before dinner starts".split()


def question(r):
    """Words and slots: ("n", k) a number, ("p", k) a person; every slot stands in at least two places."""
    words, slots = [], [("p", 0), ("p", 1), ("n", 0), ("n", 1)]
    for s in slots * 2 + r.choices(slots, k=2):
        words += [s, *r.sample(FILLER, r.randint(3, 6))]
    words[9:9] = ["stop"]
    return words


def fill(r, words, value):
    """The text, a new sentence after each "stop", so that some names begin one."""
    out, begin = [], True
    for w in words:
        if w == "stop":
            out[-1] += "."
            begin = True
            continue
        t = value(w) if isinstance(w, tuple) else w
        out.append(t[0].upper() + t[1:] if begin else t)
        begin = False
    return " ".join(out)


def number(r):
    return r.choice([str(r.randint(2, 99)), f"{r.randint(1, 99)}.{r.randint(1, 9)}", f"{r.randint(1, 9)},{r.randint(100, 999)}", r.choice(["forty", "twelve", "sixty two"])])


def person(r):
    return r.choice(FIRST) if r.random() < 0.5 else f"{r.choice(FIRST)} {r.choice(LAST)}"


def values(r):
    """Different values for all slots."""
    while True:
        v = {("n", 0): number(r), ("n", 1): number(r), ("p", 0): person(r), ("p", 1): person(r)}
        if len(set(v.values())) == 4:
            return v


def test_refilled_templates(spark):
    r = random.Random(6)
    questions = [question(r) for _ in range(25)]
    items = [(i, fill(r, q, values(r).__getitem__)) for i, q in enumerate(questions)]
    docs, found, clean = [], [], []
    noise = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(r.randint(0, 40)))
    for i, q in enumerate(questions):
        for _ in range(4):
            docs.append((len(docs), f"{noise()} {fill(r, q, values(r).__getitem__)} {noise()}"))
            found.append((docs[-1][0], i))
        # verbatim and a variant in one text; two variants in one text; verbatim in other case
        twice = f"{items[i][1]} {noise()} {fill(r, q, values(r).__getitem__)}", f"{fill(r, q, values(r).__getitem__)} {noise()} {fill(r, q, values(r).__getitem__)}"
        for t in (*twice, items[i][1].lower(), items[i][1].upper()):
            docs.append((len(docs), t))
            found.append((docs[-1][0], i))
        for _ in range(3):
            docs.append((len(docs), f"{noise()} {fill(r, q, lambda w: number(r) if w[0] == 'n' else person(r))}"))
            clean.append(docs[-1][0])
    got = verdicts(spark, docs, items)
    hit = sum(got[d] == [(True, i)] for d, i in found)
    assert hit >= 0.95 * len(found), hit / len(found)
    assert sum(got[d][0][0] for d in clean) <= 0.05 * len(clean)


def test_rows_ties_and_columns(spark):
    item = "several plain words follow each other here and nothing else is told of it"
    docs = spark.createDataFrame([(1, item, 5, 0), (1, "clean text without anything", 6, 1), (None, item, 7, 2), (None, "clean too", 8, 3), (2, "filler " * 30_000 + item, 9, 4)], "my_id long, body string, h long, tid long")
    items = spark.createDataFrame([(4, item), (3, item)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate(docs, items.withColumnRenamed("text", "body"), doc_id="my_id", text_col="body").collect()), key=str)
    assert got == sorted([(1, True, 2, 3), (1, False, 0, None), (None, True, 2, 3), (None, False, 0, None), (2, True, 2, 3)], key=str)
    left = without_contaminated(docs, items.withColumnRenamed("text", "body"), doc_id="my_id", text_col="body")
    assert left.columns == docs.columns and sorted(r.h for r in left.collect()) == [6, 8]
