import random
from collections import defaultdict

from stratalog.llm import line_dedup as ld

LICENCE = "Licensed under the Apache License, Version {}.0."
LOG = "user logged in as {} from the main office"


def corpus():
    rows = []
    for d in range(30):
        lines = [f"{'x' * (d + 1)} is how the line of this very text begins", f"and word{chr(97 + d)} more"]
        if d >= 5:
            lines.insert(1, LICENCE.format(d))
        if d % 2:
            lines.append(LOG.format("abcdefghijklmnopqrstuvwxyzABCDE"[d]))
        if d < 9:
            lines.append("a line of nine texts only")
        rows.append((d, "\n".join([*lines, "", "Too short"])))
    return rows


def got(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in df.select("row.doc_id", "row.text", "n_lines", "n_dropped").collect()}


def test_recurring_templates_go(docs):
    rows = corpus()
    out = got(ld.line_dedup(docs(rows)))
    for d, text in rows:
        want = [x for x in text.split("\n") if not (x.startswith("Licensed") and d > 5 or x.startswith("user") and d > 1)]
        assert out[d] == ("\n".join(want), len(text.split("\n")), len(text.split("\n")) - len(want))


def test_copies_count_once(docs):
    rows = [(d, "the same text of many copies\nwith a second line here") for d in range(40)]
    assert all(v[2] == 0 for v in got(ld.line_dedup(docs(rows))).values())


def test_split_leaves_still_drop_equal_lines(docs, monkeypatch):
    monkeypatch.setattr(ld, "LEAF_LINES", 1)
    out = got(ld.line_dedup(docs(corpus())))
    assert "Licensed" in out[5][0] and not any("Licensed" in out[d][0] for d in range(6, 30))


def test_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "a b c d"), (3, "\n\n"), (4, "x y z\n" * 20_000)]
    out = ld.line_dedup(docs(rows))
    assert out.count() == 6 and out.where("row.text is null").count() == 1
    assert {r.n_lines for r in out.collect()} == {0, 1, 3, 20_001}
    assert ld.line_dedup(docs([])).count() == 0
    assert out.select("row.*").columns == docs([]).columns


def test_n_chars_follows_the_text(spark):
    rows = [(d, "one common line here\n" + "é" * d + " own words", 99) for d in range(12)]
    out = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).select("row.*").collect()
    assert {r.doc_id: r.n_chars for r in out} == {d: 99 if d == 0 else d + 10 for d in range(12)}


def test_grow():
    lines = ["a b c d e f g h i j".split(), "a b c X e f g h i j".split(), "q r s t u v w x y z".split(), "a b c Y Z f g h i j".split()]
    assert ld.grow(lines) == [0, 0, 1, 0]


def test_table(table):
    """Against counting equal masked lines: each that recurs goes but from its first text."""
    texts, holders = {r.doc_id: r.text for r in table("documents").collect()}, defaultdict(set)
    for t in set(texts.values()):
        for line in t.split("\n"):
            if len(line.split()) >= ld.LEAST_TOKENS:
                holders[" ".join(map(ld.masked, line.split()))].add(t)
    out = got(ld.line_dedup(table("documents")))
    for line, who in holders.items():
        if len(who) >= ld.LEAST_TEXTS:
            left = [d for d, (t, *_) in out.items() if any(" ".join(map(ld.masked, x.split())) == line for x in t.split("\n"))]
            assert len(left) <= 1
    assert len(out) == len(texts)


def test_long_lines_of_few_texts_and_short_lines_go(docs):
    long = " ".join(f"w{chr(97 + i)}" for i in range(25))
    rows = [(d, f"{'x' * (d + 1)} its own line of this text\nYes .\nEnd\n{long if d < 3 else 'q' * (d + 1) + ' unlike'}") for d in range(12)]
    out = got(ld.line_dedup(docs(rows), least_tokens=1))
    assert [d for d in out if long in out[d][0]] == [0]
    assert [d for d in out if "Yes ." in out[d][0] or "End" in out[d][0]] == [0]
    assert all(len(out[d][0].split("\n")) == out[d][1] - out[d][2] for d in out)
    assert out[0][2] == 0 and out[1][2] == 3 and out[5][2] == 2


def test_large_leaves_drop_the_same_templates(docs, monkeypatch):
    """A variable field without digits among the leading tokens, in a leaf of many parts."""
    names = ["".join(chr(97 + d // 26**k % 26) for k in range(3)) for d in range(200)]
    rows = [(d, f"{'x' * (d + 1)} own text\n" + LOG.format(names[d])) for d in range(200)]
    want = got(ld.line_dedup(docs(rows)))
    assert [d for d in want if "main office" in want[d][0]] == [0]
    for least in (1, 7, 60):
        monkeypatch.setattr(ld, "LEAF_LINES", least)
        assert got(ld.line_dedup(docs(rows))) == want


def test_grow_compares_with_every_near_template():
    """Against comparing each line with every template."""
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 5, 9, 10, 23):
        lines = [["a", "b", *(rng.choice(["c", "d", "e", ld.ANY]) if rng.random() < 0.4 else "f" for _ in range(n))][:n] for _ in range(400)]
        stack, want = [], []
        for line in lines:
            same = [sum(map(str.__eq__, t, line)) / n for t in stack]
            best = max(range(len(stack)), key=lambda i: (same[i], -i), default=-1)
            if best >= 0 and same[best] >= ld.ALIKE:
                stack[best] = [x if x == y else ld.ANY for x, y in zip(stack[best], line, strict=True)]
            else:
                best = len(stack)
                stack.append(line)
            want.append(best)
        assert ld.grown(lines) == (want, stack)


def test_every_near_pair_shares_a_file():
    """At each depth two lines of one template meet in some file, until files are closed."""
    rng = random.Random(5)
    for n in (3, 4, 5, 8, 10, 17, 30):
        differ = n - ld.needed(n)
        for _ in range(20):
            apart, paths = set(rng.sample(range(ld.LEADING, n), min(differ, n - ld.LEADING))), [()]
            while paths:
                found = {p: ld._agreeing(n, p) for q in paths for k in range(differ + 1) if (p := (*q, k))}
                meet = {p: f for p, f in found.items() if f and not apart & set(f[0])}
                assert meet and all(f[1] == (len(f[0]) >= ld.needed(n)) for f in meet.values())
                paths = [] if any(f[1] for f in meet.values()) else sorted(meet)[:1]


def test_leaves_of_unlike_lines_stay_in_small_groups(docs, monkeypatch):
    """More unlike lines than a task grows, among them a template and a file of one block."""
    rng, made = random.Random(7), ld._templates
    word = lambda: "".join(rng.choice("bcdfgh") for _ in range(9))
    own = [" ".join(["we", "see", *(word() for _ in range(6))]) for _ in range(60)]
    block = [" ".join(["we", "see", "this", "very", *(word() for _ in range(4))]) for _ in range(60)]
    log = [f"we see this very user {word()} come in" for _ in range(60)]
    rows = [(d, f"{own[d]}\n{block[d]}\n{log[d]}") for d in range(60)]
    want = got(ld.line_dedup(docs(rows)))
    assert [d for d in want if "come in" in want[d][0]] == [0] and all(v[2] == (d > 0) for d, v in want.items())

    def bounded(group):
        assert group.num_rows <= 60, "a task holds a leaf of unlike lines"
        return made(group)

    monkeypatch.setattr(ld, "LEAF_LINES", 20)
    monkeypatch.setattr(ld, "_templates", bounded)
    assert got(ld.line_dedup(docs(rows))) == want


def test_closed_files_by_aggregation(spark):
    rows = [(1, 5, 30, "a b c x e"), (1, 5, 10, "a b c y e"), (1, 5, 20, "a b c x e"), (1, 6, 40, "a b d x e"), (2, 5, 50, "p q <*> s t")]
    out = ld._one_template(spark.createDataFrame(rows, "leaf long, file long, line long, words string")).collect()
    assert {(r.leaf, r.line): (r.template, r.words) for r in out} == {
        (1, 30): (10, "a b c <*> e"), (1, 10): (10, "a b c <*> e"), (1, 20): (10, "a b c <*> e"), (1, 40): (40, "a b d x e"), (2, 50): (50, "p q <*> s t"),
    }
