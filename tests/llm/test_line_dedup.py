import random

import pytest

from ledgerwright.llm import line_dedup as ld


def shingle_set(line):
    n = ld.SHINGLE
    return {line[i : i + n] for i in range(len(line) - n + 1)} or {line}


def brute(rows):
    """Texts after removing, of each component of similar lines, all but the first."""
    places = [
        (i, n, line)
        for i, text in rows
        for n, line in enumerate((text or "").split("\n"))
        if line.encode().strip()
    ]
    places.sort(key=lambda p: p[:2])
    lines = list(dict.fromkeys(p[2] for p in places))
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(x) for x in lines]
    for a in range(len(lines)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common / (len(sets[a]) + len(sets[b]) - common) >= ld.SIMILARITY:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    number = {line: k for k, line in enumerate(lines)}
    first = {}
    for i, n, line in places:
        first.setdefault(find(number[line]), (i, n))
    stays = {(i, n) for i, n, line in places if first[find(number[line])] == (i, n)}
    out = {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        out[i] = "\n".join(
            line
            for n, line in enumerate(text.split("\n"))
            if (i, n) in stays or not line.encode().strip()
        )
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop é") for _ in range(rnd.randrange(3, 9)))
    base = [" ".join(word() for _ in range(rnd.randrange(4, 30))) for _ in range(60)]
    common = "a line that very many documents share, word for word"
    out = []
    for i in range(150):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            line = rnd.choice(base)
            if rnd.random() < 0.5:
                at = rnd.randrange(len(line))
                line = line[:at] + rnd.choice("xyz") + line[at + 1 :]
            lines.append(line)
        lines.insert(rnd.randrange(len(lines) + 1), rnd.choice([common, "", " \t", "ab"]))
        out.append((i, "\n".join(lines)))
    out += [(150, None), (151, ""), (152, "\n\n"), (153, "x" * 200_000), (154, "ab\nab\r\nab")]
    return out


def test_equal_to_brute_force(spark, rows):
    docs = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "doc_id long, text string, line string, n_lines_ long"
    ).repartition(5)
    out = ld.cleaned(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute(rows)


def test_counts_and_repeated_rows(spark):
    rows = [(1, "one line of text\nanother line here"), (1, "one line of text\nanother line here"), (2, "one line of text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in ld.cleaned(docs, counts=True).collect())
    assert got == [(1, rows[0][1], 2, 0), (1, rows[0][1], 2, 0), (2, "", 1, 1)]


def test_empty_table(spark):
    assert ld.cleaned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_do_not_depend_on_the_batch(monkeypatch):
    lines = ["short", "a line of some length", "é漢字 " * 30, "a line of some length"]
    whole = ld.band_keys(lines)
    monkeypatch.setattr(ld, "CHUNK_CHARS", 10)
    assert (ld.band_keys(lines) == whole).all()
    assert (whole[1] == whole[3]).all()


def test_twins_inside_a_templated_family(spark):
    """Lines of one template that differ in a name, each with a twin."""
    rnd = random.Random(5)
    name = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, tail = "Copyright and all other rights of this text ", " are held by its owner and no one else may use it"
    lines = []
    for _ in range(300):
        own = name(14)
        lines += [head + own + tail, head + own + tail + name(5)]
    rows = list(enumerate(lines))
    want = brute(rows)
    assert sum(not text for text in want.values()) >= 300
    assert sum(bool(text) for text in want.values()) >= 250
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in ld.cleaned(docs).collect()} == want


def test_rows_of_one_id_with_different_texts(spark):
    """Null ids, and one id repeated with other texts: each text is a document."""
    shared = "a first line that several documents have in common"
    for key in (None, 7):
        rows = [
            (key, f"{shared}\nonly the first says this about apples"),
            (key, f"{shared}\nnothing but the second has these pears"),
            (key, "a third begins in quite another manner\nand goes on about plums and cherries"),
            (1 if key is None else 9, f"the last is all alone with its opening\n{shared}"),
        ]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        left = [line for r in ld.cleaned(docs).collect() for line in r["text"].split("\n")]
        want = {line for _, text in rows for line in text.split("\n")}
        assert sorted(left) == sorted(want)
