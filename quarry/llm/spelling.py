"""Spelling variants: words that differ by one code point, found with forward and backward minimal acyclic automata.

A word is cut in half. One error lies in one half, so the other one matches exactly: in a forward automaton the first half is
walked and the rest completed with one error, in a backward automaton (of reversed words) the second half. An automaton numbers
its words (a perfect hash), so a walk gives the position of a word's count. Each pair is reported at one place alone: at the last
place where its error can lie in the direction of the walk, and by the backward walk only where the forward one can't find it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import as_bytes, batch, id_and_bytes, key_runs, written

LEAST_CHARS, LEAST_COUNT, TIMES, DAMAGED = 6, 5, 5, 199
#: Different words that a task counts before it passes them on.
HELD = 200_000
#: Words that start (or end) alike in more than HOT rows are told apart by more of their code points.
HOT = 50_000
#: Rows from which automata are built at once, at least.
TOGETHER = 20_000
_WORD = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_CHARS)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents, words of LEAST_CHARS code points and LEAST_COUNT occurrences or more.

    A run whose crc32 with its document's id is divisible by DAMAGED loses one code point. A null id is written as no
    characters. Words are counted within tasks first, in dictionaries of bounded size.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        total: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                base = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                for word, n in Counter(_WORD.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), base)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] += n
                if len(total) >= HELD:
                    yield batch(schema, list(total.keys()), list(total.values()))
                    total.clear()
        if total:
            yield batch(schema, list(total.keys()), list(total.values()))

    counted = id_and_bytes(docs).mapInArrow(run, "word string, n long")
    return counted.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted, different words. An edge (target, final, before) knows whether a word ends with
    it and how many words of its state come before it, so the sum along a walk is the word's number in the order."""

    def __init__(self, words: list[str]):
        self.moves: list[dict[str, tuple[int, int, int]]] = []
        self.sizes: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[list] = [[]]  # edges of the states along the last word that are complete
        edge: list[list] = []  # (character, final) of the edges between them
        last = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            self._close(path, edge, same)
            for c in word[same:]:
                edge.append([c, 0])
                path.append([])
            edge[-1][1] = 1
            last = word
        self._close(path, edge, 0)
        self.root = self._state(path[0])
        del self._known

    def _close(self, path: list, edge: list, depth: int) -> None:
        while len(edge) > depth:
            target = self._state(path.pop())
            path[-1].append((*edge.pop(), target))

    def _state(self, edges: list) -> int:
        """The state with these edges; equal ones are made once."""
        found = self._known.get(key := tuple(edges))
        if found is None:
            found = self._known[key] = len(self.moves)
            before, moves = 0, {}
            for c, final, target in edges:
                moves[c] = (target, final, before)
                before += final + self.sizes[target]
            self.moves.append(moves)
            self.sizes.append(before)
        return found

    def follow(self, state: int, number: int, final: int, word: str, at: int) -> int:
        """The number of the word that ends after word[at:] from here, -1 if there is none."""
        moves = self.moves
        for i in range(at, len(word)):
            move = moves[state].get(word[i])
            if move is None:
                return -1
            state, final, before = move
            number += before + final
        return number - 1 if final else -1

    def near(self, word: str, lo: int, hi: int) -> list[int]:
        """Numbers of the words with one error against ``word`` whose common start with it has lo to hi - 1 code points, or its
        whole length where hi is that."""
        state, number, final, out, end = self.root, 0, 0, [], len(word)
        for i in range(hi + (hi == end)):
            own = word[i] if i < end else ""
            moves = self.moves[state]
            if i >= lo:
                if i < end and word[i + 1 : i + 2] != own:
                    out.append(self.follow(state, number, final, word, i + 1))
                for c, (target, ends, before) in moves.items():
                    if c != own:
                        then = number + before + ends
                        if i < end:
                            out.append(self.follow(target, then, ends, word, i + 1))
                        out.append(self.follow(target, then, ends, word, i))
            if i == end or own not in moves:
                break
            state, final, before = moves[own]
            number += before + final
        return [n for n in out if n >= 0]


def _sides(words: DataFrame) -> DataFrame:
    """A row per word and direction under a key of its first LEAST_CHARS // 2 code points: half of a word has as many at least."""
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    x = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    rows = both.select(x.alias("x"), "n", "back", length.alias("size"), F.when(F.col("back"), length - F.floor(length / 2)).otherwise(F.floor(length / 2)).cast("int").alias("lo"), length.alias("hi"))
    return rows.select("x", "n", "back", "size", "lo", "hi", F.lit(True).alias("asks"), F.xxhash64("back", F.substring("x", 1, LEAST_CHARS // 2)).alias("key"))


def _narrowed(rows: DataFrame, first: bool) -> DataFrame:
    """Rows of hot keys under longer keys. A key now holds the asking word's length, the range [lo, hi) of its error and the
    code points before and after that range; a word lies under the keys of those that ask for its length, give or take one.
    The first step takes the exact half, each further one halves the range."""
    size = F.length("x")
    if first:
        asked = rows.select("x", "n", "back", F.explode(F.sequence(F.greatest(size - 1, F.lit(LEAST_CHARS)), size + 1)).alias("size"))
        lo = F.when(F.col("back"), F.col("size") - F.floor(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2)).cast("int")
        rows = asked.select("x", "n", "back", "size", lo.alias("lo"), F.col("size").alias("hi"))
    else:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
        rows = rows.select("x", "n", "back", "size", F.explode(halves).alias("r")).select("x", "n", "back", "size", "r.lo", "r.hi")
    tail = F.expr("substr(x, length(x) - (size - hi) + 1)")
    return rows.select("*", (size == F.col("size")).alias("asks"), F.xxhash64("back", "size", "lo", "hi", F.substr("x", F.lit(1), F.col("lo")), tail).alias("key"))


def _dealt(words: DataFrame, hot: int) -> list[DataFrame]:
    """Rows under keys of at most ``hot`` rows each. Hot keys are few (rows / hot at most), so they are sent to all tasks. A range of
    one code point is not halved any more: few words differ only there."""
    done, rows, first = [], _sides(words), True
    while True:
        large = written(rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("width")).where((F.col("rows") > hot) & (F.lit(first) | (F.col("width") > 1))).select("key"), "hot-keys")
        if large.isEmpty():
            return [*done, rows]
        done.append(rows.join(F.broadcast(large), "key", "left_anti"))
        rows, first = written(_narrowed(rows.join(F.broadcast(large), "key", "left_semi"), first), "narrowed"), False


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, best): how many of ``words(word, n)`` are one error away, and the commonest of them as (n, word)."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(batches):
        for t in key_runs(batches, "key", TOGETHER):
            for side in (False, True):
                own = t.filter(pc.equal(t.column("back"), side))
                if own.num_rows:
                    yield from answers(own, side)

    def answers(t, back):
        counts = dict(zip(t.column("x").to_pylist(), t.column("n").to_pylist()))
        words = sorted(counts)
        dawg = Automaton(words)
        asking = t.filter(t.column("asks"))
        out = []
        for x, lo, hi in zip(*(asking.column(c).to_pylist() for c in ("x", "lo", "hi"))):
            found = [words[i] for i in dawg.near(x, lo, hi)]
            if back:  # what starts with the word's first half is the forward walk's
                half = x[len(x) - len(x) // 2 :]
                found = [w for w in found if not w.endswith(half)]
            if found:
                n = max(counts[w] for w in found)
                out.append((x[::-1] if back else x, len(found), n, min(w[::-1] if back else w for w in found if counts[w] == n)))
        if out:
            yield batch(schema, *zip(*out))

    parts = []
    for rows in _dealt(words, hot):
        rows = rows.repartition("key").sortWithinPartitions("key")
        parts.append(rows.mapInArrow(run, "word string, n_near long, best_n long, best string"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.minus")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def group_variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``documents(doc_id, text)`` -> word, n, n_near, form, form_n, root, a row per word.

    ``form`` is a word's commonest neighbour if that has TIMES its count at least, ties to the first in code-point order; root
    follows forms to the last. Null texts have no words; repeated rows count again; texts are read whole, very long ones and words
    too. An empty table gives no rows; further columns are ignored.
    """
    words = written(count_words(docs), "words")
    near = near_words(words, hot)
    formed = F.col("best.n") >= TIMES * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n"))
    out = written(out, "forms")
    return out.join(roots(out.where("form is not null").select("word", "form")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): every round doubles how far the forms are followed. Counts grow by TIMES with each form, so
    chains are short and have no cycles; few words share a form, being one error away."""
    here = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = here.join(here.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        after = written(after, "roots")
        if after.where("went").isEmpty():
            return after.select("word", "root")
        here = after.select("word", "root")


def oracle() -> str:
    """CRC-32 by its table of 256 remainders, made by rule; a replaced code point by the same rest at the same place, a missing one by the shorter word."""
    table = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), n))"
    crc = "xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
    return f"""with k as materialized (select {table} as t),
r as (select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents) where length(w) >= {LEAST_CHARS} group by doc_id, w),
h as (select w, n, {crc} as h from (select w, n, t, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)) as b from r, k)),
d as (select case when h % {DAMAGED} = 0 then w[:(h % length(w))::bigint] || w[(h % length(w) + 2)::bigint:] else w end as w, n from h),
v as materialized (select w, sum(n)::bigint as n from d group by w having length(w) >= {LEAST_CHARS} and sum(n) >= {LEAST_COUNT}),
x as materialized (select w, i, w[:i] || w[i + 2:] as s from (select w, unnest(range(length(w))) as i from v)),
e as materialized (select a.w as a, b.w as b from x a join x b on a.s = b.s and a.i = b.i and a.w <> b.w union select x.w, v.w from x join v on v.w = x.s union select v.w, x.w from x join v on v.w = x.s),
f as materialized (select a as w, count(*) as n_near, arg_min(b, (-v.n, b)) as form, max(v.n) as form_n from e join v on v.w = e.b group by a),
g as materialized (select v.w, v.n, coalesce(f.n_near, 0) as n_near, case when f.form_n >= {TIMES} * v.n then f.form end as form, case when f.form_n >= {TIMES} * v.n then f.form_n end as form_n from v left join f on f.w = v.w),
z as (with recursive z as (select w, w as root, form from g union all select z.w, z.form, g.form from z join g on g.w = z.form where z.form is not null) select w, root from z where form is null)
select g.w as word, n, n_near, form, form_n, root from g join z on z.w = g.w"""
