"""Spelling variants: words that are one error away from a much more frequent one.

One error lies in the first or in the second half of a word, so the other half is
matched exactly.  Words and, reversed, words once more are dealt out by their
first three letters (no half is shorter); the words of a share form a minimal
acyclic automaton, each of whose words has a number.  A word follows its exact
half, the rest is completed with one error, and the numbers reached are its
neighbours; what the other direction finds too is left out there.

Letters that very many words begin with are split into blocks of words, each an
automaton of its own, to which all words with those letters are sent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged, table

RUN = re.compile("[a-zÀ-ÿ]+")
#: One occurrence in SLIP loses a letter; words have at least LEAST_LENGTH letters and LEAST occurrences, forms RATIO times as many as the word.
SLIP, LEAST_LENGTH, LEAST, RATIO = 199, 6, 5, 5
#: Letters that words are dealt out by: half of the shortest word.
HEAD = LEAST_LENGTH // 2
#: Words of an automaton, on average, and words beyond which a head is split.
SHARE, BLOCK = 20_000, 50_000
#: Distinct words that a counting task holds.
HELD = 400_000


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text after slips, and how often each occurs."""
    runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # bytes lower only A-Z
    at = "" if doc_id is None else str(doc_id)
    for w, n in runs.items():
        h = zlib.crc32(f"{at}:{w}".encode())
        if not h % SLIP:
            i = h % len(w)
            w = w[:i] + w[i + 1 :]
        yield w, n


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words long and frequent enough; tasks add up their own words first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for i, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
                for w, n in words_of(i, t):
                    if len(w) >= LEAST_LENGTH:
                        held[w] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    rows = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Automaton:
    """Minimal acyclic automaton of ascending distinct words; words are numbered in that order."""

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict] = [{}]  # letter -> state; later letter -> (state, words before it)
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path = [0]  # states of the last word
        last = ""

        def settle(depth: int) -> None:
            """Replace the states of the last word below ``depth`` by equal ones that are known."""
            for i in range(len(last), depth, -1):
                s = path.pop()
                kept = known.setdefault((self.final[s], *self.edges[s].items()), s)
                if kept != s:
                    self.edges[path[-1]][last[i - 1]] = kept
                    if s == len(self.edges) - 1:
                        self.edges.pop()
                        self.final.pop()

        for w in words:
            shared = 0
            for a, b in zip(last, w, strict=False):
                if a != b:
                    break
                shared += 1
            settle(shared)
            for letter in w[shared:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][letter] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            last = w
        settle(0)
        self._number()

    def _number(self) -> None:
        size: dict[int, int] = {}
        todo = [0]
        while todo:
            s = todo[-1]
            below = [t for t in self.edges[s].values() if t not in size]
            if below and s not in size:
                todo += below
                continue
            todo.pop()
            size[s] = self.final[s] + sum(size[t] for t in self.edges[s].values())
        for s, out in enumerate(self.edges):
            before = int(self.final[s])
            for letter, t in out.items():
                out[letter] = (t, before)
                before += size.get(t, 0)

    def walk(self, s: int, number: int, letters: str) -> tuple[int, int] | None:
        for x in letters:
            step = self.edges[s].get(x)
            if step is None:
                return None
            s, number = step[0], number + step[1]
        return s, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first ``exact`` letters and differ by one error after them."""
        found: set[int] = set()
        begin = self.walk(0, 0, word[:exact])

        def finish(s: int, number: int, letters: str) -> None:
            end = self.walk(s, number, letters)
            if end and self.final[end[0]]:
                found.add(end[1])

        rest = word[exact:]
        for i in range(len(rest) + 1):
            if begin is None:
                break
            s, number = begin
            for x, (t, before) in self.edges[s].items():
                finish(t, number + before, rest[i:])  # x is inserted
                if i < len(rest) and x != rest[i]:
                    finish(t, number + before, rest[i + 1 :])  # x replaces a letter
            if i < len(rest):
                finish(s, number, rest[i + 1 :])  # a letter is left out
                begin = self.walk(s, number, rest[i])
        return found


def one_error_away(shares: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """word, n_near, best_n, best of rows sorted by back, share, asks, word: a share's own words first, then those that ask it."""
    share, own, numbers, machine = None, [], [], None
    for b in shares:
        out = []
        for back, key, asks, w, n in zip(b["back"].tolist(), b["share"].tolist(), b["asks"].tolist(), b["word"], b["n"].tolist(), strict=True):
            if share != (back, key):
                share, own, numbers, machine = (back, key), [], [], None
            if not asks:
                own.append(w)
                numbers.append(n)
                continue
            machine = machine or Automaton(own)
            half = len(w) // 2
            hits = machine.near(w, len(w) - half if back else half)
            if back:  # words whose first halves agree are found forwards
                hits = {k for k in hits if not own[k].endswith(w[-half:])}
            if hits:
                turn = -1 if back else 1
                best, form = min((-numbers[k], own[k][::turn]) for k in hits)
                out.append((w[::turn], len(hits), -best, form))
        yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"]).astype({"n_near": "int64", "best_n": "int64"})


def neighbours(vocabulary: DataFrame, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """word, n_near, form_n, form (its near word of largest n, the first of those): of each word of (word, n) that has a near word."""
    shares = 1 + vocabulary.count() // min(share, block)
    both = vocabulary.select(F.lit(0).alias("back"), "word", "n").unionByName(vocabulary.select(F.lit(1).alias("back"), F.reverse("word").alias("word"), "n"))
    both = both.withColumn("head", F.substring("word", 1, HEAD))
    sizes = both.groupBy("back", "head").agg(F.count("*").alias("size")).where(F.col("size") > block).select("back", "head", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = both.join(F.broadcast(sizes), ["back", "head"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # less than a row for each ``block`` words
    at = lambda b: F.pmod(F.pmod(F.xxhash64("head"), F.lit(shares)) + b, F.lit(shares)).cast("int")  # noqa: E731  there are fewer blocks than shares
    own = dealt.select("back", at(F.pmod(F.xxhash64("word"), F.col("blocks").cast("long"))).alias("share"), F.lit(0).alias("asks"), "word", "n")
    asks = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    asks = asks.select("back", at(F.col("block")).alias("share"), F.lit(1).alias("asks"), "word", "n")
    rows = own.unionByName(asks).repartition("back", "share").sortWithinPartitions("back", "share", "asks", "word")
    found = rows.mapInPandas(one_error_away, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))).alias("best"))
    return best.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain word -> form. A form has several times the word's n, so chains are short; each round doubles what is followed."""
    now = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next")).where("next <> root")
        moved = staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    A null text has no words and a null doc_id is written as nothing; texts of any
    length are read whole; repeated rows count each time, and of near words with
    equal n the first in code-point order is the form. Other columns are ignored;
    an empty table has no words.
    """
    vocabulary = staged(word_counts(docs), "vocabulary")
    near = vocabulary.join(neighbours(vocabulary), "word", "left")
    chosen = F.col("form_n") >= RATIO * F.col("n")
    told = staged(near.select("word", F.when(chosen, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("form_n")).alias("form_n")), "variants")
    return told.join(roots(told), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 is linear: the xor of what each byte, with so many bytes behind it, and the length alone amount to.
SQL = r"""
with recursive
b as (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)),
runs as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents) group by 1, 2),
keyed as (select *, coalesce(doc_id::varchar, '') || ':' || run as k, row_number() over () as r from runs),
behind as (select 0 as k, i, v from b union all select k + 1, q.i, xor(q.v >> 8, b.v) from behind q join b on b.i = q.v & 255 where k < (select max(strlen(k)) from keyed)),
empty_ as (select 0 as len, 4294967295 as v union all select len + 1, xor(q.v >> 8, b.v) from empty_ q join b on b.i = q.v & 255 where len < (select max(strlen(k)) from keyed)),
bytes as (select r, strlen(k) as len, p, ('0x' || substring(hex(encode(k)), (2 * p + 1)::int, 2))::bigint as byte from (select r, k, unnest(range(0, strlen(k))) as p from keyed)),
sums as (select r, any_value(len) as len, bit_xor(v) as v from bytes join behind on behind.k = len - 1 - p and behind.i = byte group by 1),
crc as (select r, xor(xor(sums.v, empty_.v), 4294967295) as h from sums join empty_ using (len)),
slipped as (select n, case when h % 199 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run) + 2)::int) else run end as word from keyed join crc using (r)),
v as (select word, sum(n)::bigint as n from slipped where length(word) >= 6 group by 1 having sum(n) >= 5),
d as (select word, n, i, substring(word, 1, i::int) || substring(word, i::int + 2) as less from (select word, n, unnest(range(0, length(word))) as i from v)),
near as (select distinct d.word, v.word as other from d join v on v.word = d.less union select v.word, d.word from d join v on v.word = d.less union select x.word, y.word from d x join d y on x.i = y.i and x.less = y.less and length(x.word) = length(y.word) and x.word <> y.word),
best as (select near.word, count(*) as n_near, max(o.n) as n, min_by(near.other, (-o.n, near.other)) as form from near join v o on o.word = near.other group by 1),
f as (select v.word, v.n, coalesce(best.n_near, 0) as n_near, case when best.n >= 5 * v.n then best.form end as form, case when best.n >= 5 * v.n then best.n end as form_n from v left join best using (word)),
chain as (select word, word as at_, 0 as steps from f union all select c.word, f.form, steps + 1 from chain c join f on f.word = c.at_ where f.form is not null),
ends as (select word, arg_max(at_, steps) as root from chain group by 1)
select word, form, root, n, n_near, form_n from f join ends using (word)
"""
