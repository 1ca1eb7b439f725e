"""Evaluation items that leak into documents.

Method: the normalised items form one generalised suffix automaton; every
document's tokens are streamed through it, and the automaton's state tells the
longest text of any item that ends there. Wherever that is at least a seed
long, all places in items with the same last tokens are extended both ways,
letting up to one token in eight be changed, missing or added; a passage counts
if it is long enough (12 words, in Chinese and Japanese 25 characters, or the
whole of a shorter item), and must begin and end with an equal token. All such
passages are kept; those of one item that overlap in the document make one
stretch of leaked text.

Any passage with at most one edit in eight holds an unedited run of five words
(six characters), so seeds of that length lose none.

Each item has the seed of its own length class, so a short item adds no work to
the search for long ones. An extension goes on until its edits are more than
one in eight of what it has matched by SLACK; text behind a worse gap is found
by seeds of its own and is a stretch of its own.

The items are a stated query set: they are read in blocks of a bounded number of
tokens, which are broadcast; the Python workers build the automaton, linear in
its block. Documents are never gathered.

Tokens: NFKD, without marks and invisible characters, case-folded; Han and kana
characters one by one, other letters and digits in runs. UTF-8 read as
Windows-1252 is put right first. A first line of fewer words than a passage,
followed by more lines, is an instruction and doesn't count.

Nulls: null texts and null items leak nothing, null ids are kept as they are.
Repeated documents are reported once for each doc_id. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.shared import ship

#: Windows-1252 characters of the bytes 80 to 9F; the five bytes without one stay control characters.
CP1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
GARBLED = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-…‰‹›€™]")
CJK = "々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
TOKEN = re.compile(f"[{CJK}]|[^\\W_{CJK}]+")
ASCII_TOKEN = re.compile("[a-z0-9]+")
IS_CJK = re.compile(f"[{CJK}]")
WORDS, CHARACTERS, ONE_IN = 12, 25, 8
SEED_WORDS, SEED_CHARACTERS, SLACK = 5, 6, 4
FAR_BEHIND = 64


def ungarbled(text: str) -> str:
    if GARBLED.search(text):
        try:
            return text.translate(CP1252).encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return text


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text).casefold()
    t = unicodedata.normalize("NFKD", t)
    category = unicodedata.category
    drop = {ord(c): None for c in set(t) if c > "\u007f" and (category(c)[0] == "M" or category(c) == "Cf" or c == "ـ")}
    return t.translate(drop) if drop else t


def tokens(text: str) -> list[str]:
    t = plain(text)
    return (ASCII_TOKEN if t.isascii() else TOKEN).findall(t)


def placed_tokens(text: str) -> list[tuple[str, int, int]]:
    """Tokens with the places of their first character and after their last one in the text."""
    chars, where = [], []
    for k, c in enumerate(text):
        for x in plain(c):
            chars.append(x)
            where.append(k)
    return [(m.group(), where[m.start()], where[m.end() - 1] + 1) for m in TOKEN.finditer("".join(chars))]


def item_tokens(text: str) -> list[str]:
    """Without an instruction line."""
    first, line, rest = text.strip().partition("\n")
    if line and rest.strip():
        head = tokens(first)
        if len(head) < (CHARACTERS if _cjk(head) else WORDS) and len(tokens(rest)) > len(head):
            return tokens(rest)
    return tokens(text)


def _cjk(toks: list[str]) -> bool:
    return 2 * sum(1 for t in toks if IS_CJK.match(t)) > len(toks)


class Automaton:
    """Generalised suffix automaton of token sequences, with the ends of equal seeds."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(i, t) for i, t in items if t]
        self.vocab: dict[str, int] = {}
        self.seqs = [[self.vocab.setdefault(x, len(self.vocab)) for x in t] for _, t in self.items]
        cjk = [_cjk(t) for _, t in self.items]
        self.least = [min(CHARACTERS if c else WORDS, len(t)) for c, (_, t) in zip(cjk, self.items)]
        # a whole short item may have fewer edits, and then longer unedited runs
        self.seed = [min(SEED_CHARACTERS if c else SEED_WORDS, max(1, (n - n // ONE_IN) // (n // ONE_IN + 1))) for c, n in zip(cjk, self.least)]
        self._build()

    def _build(self) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length, end = [-1], [0], [None]
        for k, seq in enumerate(self.seqs):
            last = 0
            for pos, c in enumerate(seq):
                if c in nxt[last]:  # the prefix is known from an earlier item
                    q = nxt[last][c]
                    if length[q] == length[last] + 1:
                        last = q
                    else:
                        last = self._clone(nxt, link, length, end, last, c, q)
                else:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    end.append(None)
                    p = last
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][c]
                        link[cur] = q if length[q] == length[p] + 1 else self._clone(nxt, link, length, end, p, c, q)
                    last = cur
                end[last] = [*(end[last] or ()), (k, pos)]
        # The ends of all occurrences of a state's texts are those of the states below it. Of the states on a path from the
        # root, only the topmost of at least a seed's length keeps the ends of items of that seed: (seed, ends).
        order = sorted(range(1, len(nxt)), key=length.__getitem__)
        lengths = sorted(set(self.seed))
        hits: list[tuple[tuple[int, list[tuple[int, int]]], ...]] = [()] * len(nxt)
        for v in order:
            up = link[v]
            own = tuple((n, []) for n in lengths if length[up] < n <= length[v])
            hits[v] = hits[up] + own if own else hits[up]
            for k, pos in end[v] or ():
                for n, ends in hits[v]:
                    if n == self.seed[k]:
                        ends.append((k, pos))
        kept = {id(h): tuple(x for x in h if x[1]) for h in {id(h): h for h in hits}.values()}
        self.nxt, self.link, self.length, self.hits = nxt, link, length, [kept[id(h)] for h in hits]

    @staticmethod
    def _clone(nxt, link, length, end, p, c, q) -> int:
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        end.append(None)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def find(self, toks: list[str]) -> dict[int, list[tuple[int, int, int, int]]]:
        """item number -> (words and edits of the longest passage, first and last token in the document) of each stretch of overlapping passages."""
        get = self.vocab.get
        ids = [get(t, -1) for t in toks]
        nxt, link, length, hits, whole = self.nxt, self.link, self.length, self.hits, self.least
        found: dict[int, list[tuple[int, ...]]] = {}
        seen: dict[tuple[int, int], int] = {}
        open_: dict[int, list[tuple[int, ...]]] = {}  # those that reach as far as the scan
        v = n = 0
        for i, c in enumerate(ids):
            if c < 0:
                v = n = 0
                continue
            to = nxt[v].get(c)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = nxt[v].get(c)
                if to is None:
                    n = 0
                    continue
                n = length[v]
            v = to
            n += 1
            for seed, ends in hits[v]:
                if seed > n:  # the state stands for longer texts too, all of the same ends
                    break
                for k, e in ends:
                    if whole[k] == seed:  # a short item that stands there as it is
                        found.setdefault(k, []).append((seed, 0, i - seed + 1, i, 0, seed))
                    elif seen.get((k, i - e), -1) < i:
                        self._extend(ids, i, k, e, seen, found, open_)
        return {k: _stretches(spans) for k, spans in found.items()}

    def _extend(self, ids, i, k, e, seen, found, open_) -> None:
        seq = self.seqs[k]
        a, b = i, e
        while a > 0 and b > 0 and ids[a - 1] == seq[b - 1]:
            a -= 1
            b -= 1
        j, f = i + 1, e + 1
        while j < len(ids) and f < len(seq) and ids[j] == seq[f]:
            j += 1
            f += 1
        seen[k, i - e] = j - 1  # this run of the diagonal is dealt with
        run = f - b
        if run < self.seed[k]:
            return
        passages = open_[k] = [s for s in open_.get(k, ()) if s[3] >= i]
        if any(p <= a and j - 1 <= q and lo <= b and f <= hi and abs((a - b) - (p - lo)) <= edits for _, edits, p, q, lo, hi in passages):
            return  # part of a passage that was extended over it
        least = self.least[k]
        rights = _reach(ids, seq, j, f, 1, run)
        lefts = _reach(ids, seq, a - 1, b - 1, -1, run + max(rb - y * ONE_IN for y, _, rb in rights))
        rights = _reach(ids, seq, j, f, 1, run + max(lb - x * ONE_IN for x, _, lb in lefts))
        for x, la, lb in lefts:
            for y, ra, rb in reversed(rights):
                words, edits = run + lb + rb, x + y
                if words >= least and edits * ONE_IN <= words:
                    passages.append((words, edits, a - la, j + ra - 1, b - lb, f + rb))
                    found.setdefault(k, []).append(passages[-1])
                    break


def _stretches(passages: list[tuple[int, ...]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for words, edits, p, q, *_ in sorted(passages, key=lambda s: s[2]):
        if out and p <= out[-1][3]:
            longest = max(out[-1][:2], (words, edits), key=lambda s: (s[0], -s[1]))
            out[-1] = (*longest, out[-1][2], max(out[-1][3], q))
        else:
            out.append((words, edits, p, q))
    return out


def _reach(ids: list[int], seq: list[int], i: int, f: int, step: int, spare: int) -> list[tuple[int, int, int]]:
    """(edits, tokens of ids, tokens of seq) that alignments from ids[i] and seq[f] on reach at most, ending with an equal token, wherever more edits reach further.

    So many edits are tried as are one in ONE_IN of what is reached and of ``spare`` words beside it, and SLACK more.
    """
    nx, ny = (len(ids) - i, len(seq) - f) if step > 0 else (i + 1, f + 1)
    reach = {0: 0}  # diagonal (place in ids less place in seq) -> place in seq
    best = [(0, 0, 0)]
    edits = 0
    while reach and edits < SLACK + (spare + best[-1][2]) // ONE_IN:
        edits += 1
        new: dict[int, int] = {}
        for d, p in reach.items():
            for dd, q in ((d, p + 1), (d - 1, p + 1), (d + 1, p)):  # changed, missing, added
                if q <= ny and 0 <= q + dd <= nx and q > new.get(dd, -1):
                    new[dd] = q
        _, top_d, top = best[-1]
        for d, q in new.items():
            q0 = q
            while q < ny and q + d < nx and ids[i + step * (q + d)] == seq[f + step * q]:
                q += 1
            new[d] = q
            if q > q0 and q > top:
                top_d, top = q + d, q
        if top > best[-1][2]:
            best.append((edits, top_d, top))
        # an alignment this far behind one of as many edits comes in again by seeds of its own, if at all
        reach = {d: q for d, q in new.items() if q >= top - FAR_BEHIND}
    return best


SCHEMA = "doc_id bigint, item_id bigint, words int, edits int, first_token int, last_token int, n_tokens int, start_pos int, end_pos int"
HASHED = f"{SCHEMA}, text_hash bigint"


def _blocks(items: DataFrame, block_tokens: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items are read one by one; no more than a block is held, nor sent to the executors at once."""
    block, size = [], 0
    for r in items.select("item_id", "item_text").where("item_text is not null").orderBy("item_id", "item_text").toLocalIterator():
        t = item_tokens(r[1])
        block.append((r[0], t))
        size += len(t)
        if size >= block_tokens:
            yield block
            block, size = [], 0
    if block:
        yield block


_built: dict[str, Automaton] = {}


def automaton_of(name: str, block: list[tuple[int, list[str]]]) -> Automaton:
    """Built once in each Python worker; the last one is kept for the tasks that follow."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(block)
    return _built[name]


def _scanner(model, name: str):
    def scan(frames: Iterator) -> Iterator:
        import pandas as pd

        from rivulet.llm.leaks import automaton_of, placed_tokens, tokens, ungarbled

        automaton = automaton_of(name, model.value)
        for frame in frames:
            rows = []
            for doc, text, text_hash in zip(frame["doc_id"], frame["text"], frame["text_hash"]):
                if not text:
                    continue
                right = ungarbled(text)
                toks = tokens(right)
                found = automaton.find(toks)
                if not found:
                    continue
                at = placed_tokens(right)
                if right != text:  # each of its bytes is a character of the garbled text
                    starts = [0, *accumulate(len(c.encode()) for c in right)]
                    at = [(t, starts[a], starts[b]) for t, a, b in at]
                if len(at) != len(toks):
                    at = None
                for k, stretches in found.items():
                    for words, edits, a, b in stretches:
                        rows.append((doc, automaton.items[k][0], words, edits, a, b, len(toks), at[a][1] if at else None, at[b][2] if at else None, text_hash))
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "edits", "first_token", "last_token", "n_tokens", "start_pos", "end_pos", "text_hash"])
                yield out.astype({"start_pos": "Int32", "end_pos": "Int32"})

    return scan


def passages(documents: DataFrame, items: DataFrame, block_tokens: int = 500_000) -> DataFrame:
    """Every leaked stretch of each item in each document: SCHEMA. words and edits are those of the longest passage in it; start_pos and end_pos are code points of the text as it stands, garbled or not."""
    return _passages(documents, items, block_tokens).drop("text_hash")


def _passages(documents: DataFrame, items: DataFrame, block_tokens: int = 500_000) -> DataFrame:
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).where("text is not null and text <> ''")
    out = None
    for block in _blocks(items, block_tokens):
        part = texts.mapInPandas(_scanner(spark.sparkContext.broadcast(block), uuid.uuid4().hex), HASHED)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], HASHED)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), each once."""
    return passages(documents, items).select("doc_id", "item_id").distinct()


def removals(documents: DataFrame, items: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(doc_id, drop, cuts): a document whose leaked tokens exceed the share ``coverage`` is to be dropped, from others the spans [start_pos, end_pos) are to be cut; they don't overlap.

    Texts that share a doc_id are judged one by one; the id is to be dropped if one of them is.
    """
    spans = _united(_passages(documents, items))
    by_text = spans.groupBy("doc_id", "text_hash").agg((F.sum("n_leaked") / F.max("n_tokens")).alias("share"), F.collect_list(F.struct("start_pos", "end_pos")).alias("cuts"))
    return by_text.groupBy("doc_id").agg((F.max("share") > coverage).alias("drop"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts"))


def _united(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_tokens, n_leaked, start_pos, end_pos): stretches of any items, those that overlap or adjoin made one."""
    ordered = Window.partitionBy("doc_id", "text_hash").orderBy("first_token", "last_token")
    before = F.max("last_token").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("__new", F.coalesce(F.col("first_token") > before + 1, F.lit(True)).cast("int"))
    return (
        apart.withColumn("__number", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_hash", "__number")
        .agg(F.max("n_tokens").alias("n_tokens"), (F.max("last_token") - F.min("first_token") + 1).alias("n_leaked"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
        .drop("__number")
    )
