"""Line dedup by a log-template tree.

Each line walks a tree of fixed depth: its number of tokens, then its leading tokens
(tokens with digits count as variable). The lines that reach a leaf are grouped by the
share of positions at which they agree with a template, and positions that differ become
variable. Templates that recur across enough different texts are dropped.

Leaves reached by too few texts are left out before any line is sent. A leaf with very
many different lines is grown in salted parts, and the parts' templates are grouped again
by the same similarity as long as that at least halves them. The unlike templates that are
left are filed by the words of one block of positions after the other; files that are still
too large by those of a block more, until their templates agree at enough positions. Blocks
of positions find the templates to compare inside a task too, so neither takes all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, in_bitmap, key_bitmap, lean, looked_up, written

#: Leading tokens on the way to a leaf, share of agreeing positions, and the least
#: different texts and tokens of a template that is dropped.
LEADING, ALIKE, LEAST_TEXTS, LEAST_TOKENS = 2, 0.7, 10, 3
#: Lines of so many tokens are long: fewer different texts suffice.
LONG_TOKENS, LONG_TEXTS = 20, 2
#: Lines and characters that a task gathers before it sends them.
SEND_LINES, SEND_CHARS = 20_000, 4_000_000
#: Different lines that are grown together.
LEAF_LINES = 2_000
ANY = "<*>"


def masked(token: str) -> str:
    return ANY if any("0" <= c <= "9" for c in token) else token


def leaf_of(tokens: list[str], leading: int = LEADING) -> str:
    return " ".join([str(len(tokens)), *map(masked, tokens[:leading])])


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def needed(n: int, alike: float = ALIKE) -> int:
    """The least positions of n at which a line agrees with its template."""
    return next(k for k in range(n + 1) if k / n >= alike or k == n)


def grow(lines: list[list[str]], alike: float = ALIKE) -> list[int]:
    """Drain's grouping in one leaf: the number of each line's template, in order."""
    return grown(lines, alike)[0]


def grown(lines: list[list[str]], alike: float = ALIKE) -> tuple[list[int], list[list[str]]]:
    """The number of each line's template, in order, and the templates' tokens.

    A line joins the template that agrees at most positions, the first of equals, if these
    are the share alike. As it then differs at so many positions at most, it agrees on all
    of one of so many blocks and one more: only templates filed under an equal block are
    compared."""
    if not lines:
        return [], []
    words: dict[str, int] = {ANY: 0}
    coded = np.array([[words.setdefault(w, len(words)) for w in line] for line in lines], np.int32)
    n = coded.shape[1]
    need = needed(n, alike)
    moving = np.flatnonzero((coded != coded[0]).any(0))  # at the others all agree for ever
    blocks = [b for b in np.array_split(moving, n - need + 1) if len(b)]
    if len(blocks) <= n - need:  # a line may differ at every moving position
        blocks = [np.zeros(0, np.int64)]
    filed: list[dict[bytes, list[int]]] = [{} for _ in blocks]
    stack, count, out = np.empty((64, n), np.int32), 0, []
    for line in coded:
        keys = [line[b].tobytes() for b in blocks]
        near = np.array(sorted({t for f, k in zip(filed, keys, strict=True) for t in f.get(k, ())}), np.int64)
        same = (stack[near] == line).sum(1)
        best = int(near[same.argmax()]) if len(near) and same.max() >= need else -1
        if best < 0:
            best, count = count, count + 1
            if best == len(stack):
                stack = np.concatenate([stack, np.empty_like(stack)])
            stack[best], old = line, [None] * len(blocks)
        else:
            old = [stack[best][b].tobytes() for b in blocks]
            stack[best][stack[best] != line] = 0
        for f, b, was in zip(filed, blocks, old, strict=True):
            if (now := stack[best][b].tobytes()) != was:
                if was is not None:
                    f[was].remove(best)
                f.setdefault(now, []).append(best)
        out.append(best)
    names = list(words)
    return out, [[names[w] for w in row] for row in stack[:count].tolist()]


@lean
def _leaves(rows: Iterable[pa.RecordBatch], least_tokens: int, least_texts: int) -> Iterator[pa.RecordBatch]:
    """(leaf, least, t): each leaf that a text reaches, once, and the least texts of its templates."""
    for b in rows:
        leaf, least, of = [], [], []
        for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = {key(leaf_of(w)): len(w) >= LONG_TOKENS for line in text.split("\n") if len(w := line.split()) >= least_tokens}
            leaf += found
            least += [min(LONG_TEXTS, least_texts) if long else least_texts for long in found.values()]
            of += [t] * len(found)
        yield batches({"leaf": (leaf, pa.int64()), "least": (least, pa.int64()), "t": (of, pa.int64())})


@lean
def _lines(rows: Iterable[pa.RecordBatch], wanted: np.ndarray, least_tokens: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, at, leaf, line, words) of the lines in wanted leaves."""
    for b in rows:
        cols: dict[str, list] = {k: [] for k in ("doc_id", "t", "at", "leaf", "line", "words")}
        chars = 0
        for i in range(b.num_rows):
            doc, t, text = (c[i].as_py() for c in b.columns)
            found = [(at, w, key(leaf_of(w))) for at, line in enumerate(text.split("\n")) if len(w := line.split()) >= least_tokens]
            known = in_bitmap(wanted, np.array([leaf for *_, leaf in found], np.int64))
            for (at, words, leaf), may in zip(found, known.tolist(), strict=True):
                if may:
                    plain = " ".join(map(masked, words))
                    chars += len(plain)
                    for k, v in zip(cols, (doc, t, at, leaf, key(plain), plain), strict=True):
                        cols[k].append(v)
            if len(cols["at"]) > SEND_LINES or chars > SEND_CHARS:
                yield batches({k: (v, pa.string() if k == "words" else pa.int64()) for k, v in cols.items()})
                cols, chars = {k: [] for k in cols}, 0
        yield batches({k: (v, pa.string() if k == "words" else pa.int64()) for k, v in cols.items()})


def _templates(group: pa.Table) -> pa.Table:
    """Group the different lines of a part of a leaf; a template is named by its first line."""
    order = np.argsort(group["line"].to_numpy(), kind="stable")
    line = group["line"].to_numpy()[order]
    words = group["words"].to_pylist()
    found, rows = grown([words[i].split(" ") for i in order])
    found = np.array(found, np.int64)
    first = np.unique(found, return_index=True)[1]
    plain = pa.array([None] * len(line) if not group["open"][0].as_py() else [" ".join(rows[t]) for t in found], pa.string())
    return pa.table({"leaf": pa.array(np.full(len(line), group["leaf"][0].as_py())), "line": pa.array(line), "template": pa.array(line[first[found]]), "words": plain})


def _agreeing(n: int, path: tuple[int, ...]) -> tuple[list[int], bool] | None:
    """The positions at which lines of n tokens in one file of a path agree, and whether
    these are enough for one template; None where n has no such file.

    Lines of a template differ at n - need positions at most, so of one block more that the
    other positions are cut into, they agree on all of at least one: a path names a block at
    each step, and files of all paths of a length hold every pair to compare."""
    agreed, rest, differ = list(range(min(LEADING, n))), list(range(LEADING, n)), n - needed(n)
    for k in path:
        if k > differ or len(rest) <= differ:
            return None
        taken = np.array_split(rest, differ + 1)[k].tolist()
        agreed, rest = agreed + taken, [x for x in rest if x not in taken]
    return agreed, len(rest) <= differ


@lean
def _filed(rows: Iterable[pa.RecordBatch], path: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(leaf, line, words) with the file of the path but its last step, the file of the
    whole path, if the lines' length has one, whether this one is enough, and whether a
    later block is left."""
    for b in rows:
        file, inner, closed, more = [], [], [], []
        for leaf, words in zip(b.column("leaf").to_pylist(), b.column("words").to_pylist(), strict=True):
            w = words.split(" ")
            outer, found = _agreeing(len(w), path[:-1]), _agreeing(len(w), path)
            file.append(key(" ".join([str(leaf), *(w[i] for i in outer[0])])))
            inner.append(key(" ".join([str(leaf), *(w[i] for i in found[0])])) if found else None)
            closed.append(bool(found and found[1]))
            more.append(path[-1] < len(w) - needed(len(w)))
        new = {"file": (file, pa.int64()), "inner": (inner, pa.int64()), "closed": (closed, pa.bool_()), "more": (more, pa.bool_())}
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("leaf", "line", "words")), *(pa.array(v, t) for v, t in new.values())], names=["leaf", "line", "words", *new])


def _one_template(rows: DataFrame) -> DataFrame:
    """The lines of each (leaf, file), which agree at enough positions, as one template:
    by aggregation, so a file of any size will do."""
    at = rows.select("leaf", "file", F.posexplode(F.split("words", " ", -1)).alias("at", "word"))
    at = at.groupBy("leaf", "file", "at").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    at = at.withColumn("word", F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(ANY))
    words = at.groupBy("leaf", "file").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    first = rows.groupBy("leaf", "file").agg(F.min("line").alias("template"))
    plain = words.join(first, ["leaf", "file"]).select("leaf", "file", "template", F.array_join("words.word", " ").alias("words"))
    return rows.select("leaf", "file", "line").join(plain, ["leaf", "file"]).select("leaf", "line", "template", "words")


def _renamed(done: DataFrame, step: DataFrame) -> DataFrame:
    """(leaf, line, template), after a step that gave templates new templates."""
    later = step.where("line <> template").select("leaf", F.col("line").alias("template"), F.col("template").alias("last"))
    return done.join(later, ["leaf", "template"], "left").select("leaf", "line", F.coalesce("last", "template").alias("template"))


def _left(step: DataFrame) -> DataFrame:
    return step.groupBy("leaf", F.col("template").alias("line")).agg(F.first("words").alias("words"))


def _settled(done: DataFrame, items: DataFrame, path: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """done and items (leaf, line, words), after all items of a file of the path that share
    a block more met. A file of at most LEAF_LINES is grown whole by one task; a larger one
    by further blocks, or, where its lines agree at enough positions, by aggregation."""
    over, block = None, 0
    while True:
        here = (*path, block)
        filed = items.mapInArrow(lambda it, here=here: _filed(it, here), "leaf long, line long, words string, file long, inner long, closed boolean, more boolean")
        filed = written(filed, "line-filed")
        large = filed.groupBy("file").agg(F.count("*").alias("held")).where(F.col("held") > LEAF_LINES)
        filed = looked_up(filed, large, "file", "line").withColumn("small", F.col("held").isNull())
        filed = filed.withColumn("file", F.when(F.col("small"), F.col("file")).otherwise(F.col("inner"))).drop("held", "inner")
        large = filed.where("file is not null and not small").groupBy("file").agg(F.count("*").alias("held")).where(F.col("held") > LEAF_LINES)
        filed = written(looked_up(filed, large, "file", "line"), "line-filed")
        whole = filed.where("held is null and file is not null").withColumn("open", F.lit(True)).groupBy("leaf", "file").applyInArrow(_templates, "leaf long, line long, template long, words string")
        step = written(whole.unionByName(_one_template(filed.where("held is not null and closed"))), "line-templates")
        done = written(_renamed(done, step), "line-done")
        # Small files are through; the others go on to the next block.
        through = filed.where("small").select("leaf", "line")
        now = _left(step)
        ended, going = now.join(through, ["leaf", "line"], "left_semi"), now.join(through, ["leaf", "line"], "left_anti")
        over = ended if over is None else over.unionByName(ended)
        going = going.unionByName(filed.where("file is null").select("leaf", "line", "words"))
        deeper = filed.where("held is not null and not closed").select("leaf", "line", "words")
        if deeper.take(1):
            done, deeper = _settled(done, deeper, here)
            going = going.unionByName(deeper)
        items = written(going, "line-items")
        if not filed.where("more and not small").take(1) or not items.take(1):
            return done, over.unionByName(items)
        block += 1


def _grown(different: DataFrame) -> DataFrame:
    """(leaf, line, template) of (leaf, line, words): leaves of many lines in salted parts,
    whose templates are grouped again, in parts as long as these at least halve them, and
    then file by file."""
    done, last, items, unlike = None, None, different, None
    while True:
        sizes = items.groupBy("leaf").agg(F.count("*").alias("size"))
        halved = F.lit(True)
        if last is not None:
            sizes = sizes.join(last.select("leaf", F.col("size").alias("before")), "leaf")
            halved = (F.col("size") * 2 <= F.col("before")) | (F.col("size") <= LEAF_LINES)
        sizes = written(sizes.select("*", F.ceil(F.col("size") / LEAF_LINES).cast("long").alias("parts"), halved.alias("halved")), "line-sizes")
        if last is not None and sizes.where("not halved").take(1):
            rest = items.join(sizes.where("not halved").select("leaf"), "leaf", "left_semi")
            unlike = rest if unlike is None else unlike.unionByName(rest)
        last = sizes.where("halved and parts > 1")
        dealt = items.join(sizes.where("halved").select("leaf", "parts"), "leaf")
        dealt = dealt.withColumn("part", F.expr("pmod(xxhash64(line, parts), parts)")).withColumn("open", F.col("parts") > 1)
        step = dealt.groupBy("leaf", "part").applyInArrow(_templates, "leaf long, line long, template long, words string")
        step = written(step, "line-templates")
        done = step.select("leaf", "line", "template") if done is None else _renamed(done, step)
        if not last.take(1):
            break
        items = _left(step.where("words is not null"))
        done = written(done, "line-done")
    return done if unlike is None else _settled(written(done, "line-done"), written(unlike, "line-items"))[0]


def line_dedup(docs: DataFrame, least_texts: int = LEAST_TEXTS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """All columns of docs with the recurring lines taken out of text (and n_chars, where
    there is such a column, counted anew), as a struct `row`, and n_lines and n_dropped.

    Lines are parted by \\n. A template recurs when at least least_texts different texts
    (two, for lines of 20 tokens or more) hold a line of it (copies of a text count once);
    its lines go from every document but the one with the smallest doc_id, so that a
    passage survives once. Lines of fewer than least_tokens tokens stay. A null text stays null with no lines. Rows with a null doc_id
    are the last to be kept; repeated rows lose the same lines. An empty table gives an
    empty result; no name of a column of docs can clash with ours.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))

    least_tokens = max(1, least_tokens)
    leaves = rows.select("t", "text").mapInArrow(lambda it: _leaves(it, least_tokens, least_texts), "leaf long, least long, t long").distinct()
    leaves = leaves.groupBy("leaf").agg(F.min("least").alias("least"), F.count("*").alias("texts")).where("texts >= least")
    leaves = written(leaves, "line-leaves")
    wanted = spark.sparkContext.broadcast(key_bitmap(leaves, "leaf"))
    lines = rows.select("doc_id", "t", "text").mapInArrow(lambda it: _lines(it, wanted.value, least_tokens), "doc_id long, t long, at long, leaf long, line long, words string")
    lines = written(lines.join(leaves.select("leaf"), "leaf", "left_semi"), "line-lines")

    different = lines.groupBy("leaf", "line").agg(F.min("words").alias("words"))
    templates = written(_grown(written(different, "line-different")), "line-grown")

    known = lines.drop("words").join(templates, ["leaf", "line"])
    many = known.select("leaf", "template", "t").distinct().groupBy("leaf", "template").agg(F.count("*").alias("texts"))
    many = many.join(leaves.select("leaf", "least"), "leaf").where("texts >= least")
    first = known.groupBy("leaf", "template").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first"))
    many = many.join(first, ["leaf", "template"]).select("leaf", "template", F.col("first.doc_id").alias("first_doc"))
    gone = known.join(many, ["leaf", "template"]).where("not (doc_id <=> first_doc)")
    gone = written(gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("at")).alias("at")), "line-gone")

    # Copies of a text other than the first one have the same key, so rows are matched by both.
    left = rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["t"] == gone["t"]), "left").select("row", "text", "at")
    split = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains(F.col("at"), i.cast("long"))), "\n")
    new = F.when(F.col("at").isNotNull(), kept).otherwise(F.col("row.text").cast("string"))
    out = F.col("row").withField("text", new)
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(F.col("at").isNotNull(), F.char_length(kept)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(split)).cast("long")
    return left.select(out.alias("row"), n_lines.alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"))
