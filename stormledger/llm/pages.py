"""Main texts of pages by the templates of their hosts: equivalence classes of tokens.

Tokens. Tags and words of a page, each told apart by its path in the tree (`markup`).

Classes. The occurrence vector of a token holds its count on every page of the host. It is kept as
two sums of hashes of (page, count), which tasks add up, so no vector is ever gathered. Tokens of a
host with equal vectors form a class, put in the order of their mean places. Tags must be on one page
in a hundred (at least LEAST_PAGES), words on half of the pages of a host with LEAST_WORDED or more;
this bounds a template by a multiple of a page's tokens.

Template. A second pass reads every page against its host's classes with a stack: a class opens with
its first tag and closes with its last, others may open and close in between. A class out of order
or not nested on over 5 % of its occurrences is not valid; a word out of its place is no template
word. The text after a template tag is a slot; its letters, those in links, and whether the text is
the same on all pages are summed up with it.

Extraction. A third pass takes the slots' texts. Slots that are nearly all links, or say the same
on nearly all of many pages, and blocks of template words alone are the template's, not the page's.
So are elements named for it by tag or label (nav, footer, comments, ...). What is left inside
article or main, if there is such, else in the smallest element with nearly all that is left, is
the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from stormledger.llm.arrow import pieces
from stormledger.llm.markup import ASIDE, BREAK, END, HEADER, HINTED, INLINE, LINK, MAIN, START, TEXT, Token, tokens
from stormledger.operators.joins import measured_join
from stormledger.session import WorkTables

LEAST_PAGES, TAG_SHARE = 3, 0.01
LEAST_WORDED, WORD_SHARE = 20, 0.5
BROKEN_SHARE = 0.05
LINK_SHARE, SAME_SHARE = 0.8, 0.9
REGION_SHARE = 0.8
HELD = 200_000  # keys summed up in a task before they are passed on
WORD_BITS = 2
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _word_role(path: int, word: str) -> int:
    return xxh64_intdigest(word, path ^ WORD_BITS)


class Sums:
    """Numbers added up by key, passed on as Arrow batches before there are too many keys."""

    def __init__(self, keys: list[str], values: list[str], types: dict) -> None:
        self.names, self.n_keys, self.types = keys + values, len(keys), types
        self.held: dict[tuple, list] = {}

    def add(self, key: tuple, *values: int) -> None:
        row = self.held.get(key)
        if row is None:
            self.held[key] = list(values)
        else:
            for k, v in enumerate(values):
                row[k] += v

    def passed_on(self, at_least: int = 0) -> Iterator:
        import pyarrow as pa

        if len(self.held) > at_least:
            keys = list(zip(*self.held))
            values = list(zip(*self.held.values()))
            self.held = {}
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, self.types.get(n, pa.int64())) for n, v in zip(self.names, keys + values)], self.names)


def page_tokens(page: list[Token]) -> tuple[dict, dict]:
    """Counts and first places by (role, is_tag) of a page's tags and of the words that may share their element's vector.

    The innermost class around a word is that of its element, so only words that occur as often as
    their element does can belong to a class without breaking its nesting.
    """
    times: dict[tuple[int, bool], int] = {}
    place: dict[tuple[int, bool], int] = {}
    texts: dict[int, list[tuple[int, list[str]]]] = {}
    for k, t in enumerate(page):
        if t.kind == TEXT:
            texts.setdefault(t.role, []).append((k, t.text.split()))
        elif t.kind != BREAK:
            key = _signed(t.role), True
            times[key] = times.get(key, 0) + 1
            place.setdefault(key, k)
    for path, said in texts.items():
        elements = times.get((_signed(path), True), 1)
        counted = Counter(chain.from_iterable(words for _, words in said))
        often = {w for w, c in counted.items() if c == elements}
        for w in often:
            key = _signed(_word_role(path, w)), False
            times[key], place[key] = elements, next(k for k, words in said if w in words)
    return times, place


def count_tokens(pages: DataFrame) -> DataFrame:
    """(host, role, is_tag, pages, times, a, b, place) per token of LEAST_PAGES or more; role null: the host's pages."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = Sums(["host", "role", "is_tag"], ["pages", "times", "a", "b", "place"], {"host": pa.string(), "is_tag": pa.bool_()})
        low = (1 << 30) - 1
        for batch in pieces(batches, "html"):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = xxh64_intdigest(html or "")
                times, place = page_tokens(tokens(html or ""))
                vector = {c: xxh64_intdigest(c.to_bytes(8, "little"), page) for c in set(times.values())}
                for key, c in times.items():
                    v = vector[c]
                    sums.add((host, *key), 1, c, v & low, v >> 34, place[key])
                sums.add((host, None, True), 1, 0, 0, 0, 0)
            yield from sums.passed_on(HELD)
        yield from sums.passed_on()

    counted = pages.select("host", "html").mapInArrow(
        run, "host string, role long, is_tag boolean, pages long, times long, a long, b long, place long")
    totals = counted.groupBy("host", "role", "is_tag").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "a", "b", "place")])
    return totals.filter(F.col("role").isNull() | (F.col("pages") >= LEAST_PAGES))


def classes(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, n) and (host, classes): per host its pages and its classes of token roles in order."""
    hosts = counted.filter("role is null").select("host", F.col("pages").alias("n"))
    least = F.when(
        F.col("is_tag"), F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") * TAG_SHARE))
    ).when(F.col("n") >= LEAST_WORDED, F.ceil(F.col("n") * WORD_SHARE))
    frequent = measured_join(counted.filter("role is not null"), hosts, ["host"], "role").filter(F.col("pages") >= least)
    member = F.struct("place", "is_tag", "role")
    found = frequent.groupBy("host", "pages", "times", "a", "b").agg(F.sort_array(F.collect_list(member)).alias("members"))
    found = found.filter(F.exists("members", lambda m: m["is_tag"]) & (F.size("members") > 1))
    parts = F.struct(
        F.transform("members", lambda m: m["role"]).alias("roles"), F.transform("members", lambda m: m["is_tag"]).alias("tags"))
    return hosts, found.groupBy("host").agg(F.collect_list(parts).alias("classes"))


class Template:
    """A host's classes, as the second pass reads pages against them."""

    def __init__(self, classes: list[dict]) -> None:
        self.tag: dict[int, tuple[int, int, int]] = {}  # role: class (by its first tag), number among its tags, last number
        self.word: dict[int, tuple[int, int]] = {}  # role: class, number of the tag before it
        self.worded = {c["roles"][c["tags"].index(True)] for c in classes if not all(c["tags"])}  # classes with words
        for c in classes:
            own = [r for r, is_tag in zip(c["roles"], c["tags"]) if is_tag]
            last, number = len(own) - 1, -1
            for role, is_tag in zip(c["roles"], c["tags"]):
                if is_tag:
                    number += 1
                    self.tag[role] = (own[0], number, last)
                else:
                    self.word[role] = (own[0], number)

    def read(self, page: list[Token]) -> Iterator[tuple[str, int, bool]]:
        """('class' or 'word', id, in order) per occurrence of a class and of a template word."""
        stack: list[list[int]] = []
        for t in page:
            if t.kind == TEXT:
                around = self.tag.get(_signed(t.role))
                for w in t.text.split() if around and around[0] in self.worded else ():
                    role = _signed(_word_role(t.role, w))
                    if role in self.word:
                        yield "word", role, bool(stack) and tuple(stack[-1]) == self.word[role]
            elif t.kind != BREAK:
                known = self.tag.get(_signed(t.role))
                if not known:
                    continue
                name, number, last = known
                if number == 0:
                    stack.append([name, 0])
                elif stack and stack[-1] == [name, number - 1]:
                    stack[-1][1] = number
                else:
                    yield "class", name, False
                    while any(s[0] == name for s in stack):
                        broken = stack.pop()
                        if broken[0] == name:
                            break
                        yield "class", broken[0], False
                    continue
                if number == last:
                    stack.pop()
                    yield "class", name, True
        for name, _ in stack:
            yield "class", name, False


def slots(page: list[Token], tags) -> Iterator[tuple[int, Token, int]]:
    """(slot, token, its number): every text of the page."""
    slot = 0
    for k, t in enumerate(page):
        if t.kind in (START, END):
            if _signed(t.role) in tags:
                slot = _signed(t.role)
        elif t.kind == TEXT and not t.text.isspace():
            yield slot, t, k


def read_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, what, id, seen, wrong, letters, in_links, same): classes, words and slots over all pages.

    same is the number of pages on which the slot has one and the same text, if that is so on all
    on which it has any, else null.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = Sums(["host", "what", "id", "said"], ["seen", "wrong", "letters", "in_links"], {"host": pa.string(), "what": pa.string()})
        known: dict[str, Template] = {}
        for batch in pieces(batches, "html"):
            names = batch.schema.names
            for k in range(batch.num_rows):
                host, html = batch.column(names.index("host"))[k].as_py(), batch.column(names.index("html"))[k].as_py()
                if host not in known:
                    known[host] = Template(batch.column(names.index("classes"))[k].as_py() or [])
                template, page = known[host], tokens(html or "")
                for what, name, right in template.read(page):
                    sums.add((host, what, name, None), 1, int(not right), 0, 0)
                texts: dict[int, list] = {}
                for slot, t, _ in slots(page, template.tag):
                    row = texts.setdefault(slot, [0, 0, 0])
                    row[0] += len(t.text)
                    row[1] += len(t.text) if t.flags & LINK else 0
                    row[2] = xxh64_intdigest(t.text, row[2])
                for slot, (letters, in_links, said) in texts.items():
                    sums.add((host, "slot", slot, _signed(said)), 1, 0, letters, in_links)
            yield from sums.passed_on(HELD)
            if len(known) > 256:
                known.clear()
        yield from sums.passed_on()

    joined = measured_join(pages.select("host", "html"), templates, ["host"], "html")
    read = joined.mapInArrow(
        run, "host string, what string, id long, said long, seen long, wrong long, letters long, in_links long")
    totals = [F.sum(c).alias(c) for c in ("seen", "wrong", "letters", "in_links")]
    alike = F.min("said").eqNullSafe(F.max("said"))
    return read.groupBy("host", "what", "id").agg(*totals, F.when(alike, F.sum("seen")).alias("same"))


def verdicts(hosts: DataFrame, templates: DataFrame, read: DataFrame) -> DataFrame:
    """(host, tags, words, barred): roles of template tags, of template words, and of slots that are no page's own."""
    valid = F.col("wrong") <= BROKEN_SHARE * F.col("seen")
    facts = measured_join(read, hosts, ["host"], "id")
    menu = F.col("in_links") >= LINK_SHARE * F.col("letters")
    notice = (F.col("n") >= LEAST_WORDED) & (F.col("same") >= SAME_SHARE * F.col("n"))
    good = lambda what, condition: F.collect_list(F.when((F.col("what") == what) & condition, F.col("id")))
    judged = facts.groupBy("host").agg(
        good("class", valid).alias("valid"), good("word", valid).alias("good_words"),
        good("slot", (F.col("n") >= LEAST_PAGES) & (menu | notice)).alias("bad_slots"))
    per_class = templates.select("host", F.inline("classes")).select(
        "host", F.element_at(F.filter(F.arrays_zip("roles", "tags"), lambda m: m["tags"]), 1)["roles"].alias("class"), "roles", "tags")
    own = per_class.join(judged.select("host", F.explode("valid").alias("class")), ["host", "class"]).groupBy("host").agg(
        F.flatten(F.collect_list("roles")).alias("members"))
    every = per_class.groupBy("host").agg(F.flatten(F.collect_list(
        F.transform(F.filter(F.arrays_zip("roles", "tags"), lambda m: m["tags"]), lambda m: m["roles"]))).alias("tags"))
    nothing = F.array().cast("array<long>")
    told = hosts.join(judged, "host", "left").join(own, "host", "left").join(every, "host", "left")
    members = F.coalesce("members", nothing)
    return told.select(
        "host", F.coalesce("tags", nothing).alias("tags"),
        F.array_intersect(F.coalesce("good_words", nothing), members).alias("words"),
        F.array_intersect(F.coalesce("bad_slots", nothing), members).alias("barred"),
    )


def _own_text(page: list[Token], tags, words, barred) -> str:
    """The page's text, given its host's template."""
    found = list(slots(page, tags))
    block, blocks, k = {}, 0, 0
    for number, t in enumerate(page):
        blocks += t.kind == BREAK or t.kind != TEXT and t.text not in INLINE
        if t.kind == TEXT:
            block[number] = blocks
    fixed: dict[int, bool] = {}  # blocks of template words alone
    for _, t, number in found if words else ():
        fixed[block[number]] = fixed.get(block[number], True) and all(_signed(_word_role(t.role, w)) in words for w in t.text.split())

    def left(away: int) -> list[tuple[int, str, int]]:
        kept = [(number, unescape(t.text), t.flags) for slot, t, number in found
                if not t.flags & away and slot not in barred and not fixed.get(block[number])]
        main = [x for x in kept if x[2] & MAIN]
        return main or _region(page, kept)

    taken = left(ASIDE | HINTED | HEADER) or left(ASIDE | HEADER) or left(ASIDE)
    out, last = [], None
    for number, text, _ in taken:
        if last is not None and block[number] != last:
            out.append(" ")
        out.append(text)
        last = block[number]
        # white space between two inline texts is a text of its own, which slots() leaves out
        if number + 1 < len(page) and any(
            t.kind == TEXT and t.text.isspace() for t in _until_text(page, number + 1)
        ):
            out.append(" ")
    return " ".join("".join(out).split())


def _until_text(page: list[Token], at: int) -> Iterator[Token]:
    """Tokens from `at` up to the next text that is more than white space."""
    while at < len(page):
        if page[at].kind == TEXT and not page[at].text.isspace():
            return
        yield page[at]
        at += 1


def _region(page: list[Token], kept: list) -> list:
    """The texts in the smallest element that holds REGION_SHARE of the letters outside links."""
    if not kept:
        return kept
    weight = {number: 0 if flags & LINK else len(text) for number, text, flags in kept}
    whole = sum(weight.values())
    total, open_at, best = 0, [], (0, len(page))
    for number, t in enumerate(page):
        if t.kind == START:
            open_at.append((number, total))
        elif t.kind == END:
            start, before = open_at.pop()
            if t.text not in INLINE and t.text not in ("p", "li", "td") and total - before >= REGION_SHARE * whole:
                best = (start, number)
                break  # the first element to close with so much is the smallest
        else:
            total += weight.get(number, 0)
    return [x for x in kept if best[0] <= x[0] <= best[1]]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def main_texts(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """df without html, with text (the page's main text, empty if it has none) and n_chars, its code points.

    Character references are decoded, white space is one space, blocks are joined by one space. A
    null or empty page has an empty text. Pages whose url is null or names no host share one, the
    empty host. Repeated rows count as pages and get equal texts. Hosts of fewer than LEAST_PAGES
    pages have no template; their texts follow tags and labels alone. An empty table gives an empty
    one. Columns named text or n_chars are replaced.
    """
    work = WorkTables(df.sparkSession, "pages")
    others = [c for c in df.columns if c not in (html, "text", "n_chars")]
    pages = df.select(F.col(html).alias("html"), host_of(F.col(url)).alias("host"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    hosts, found = classes(work.save(count_tokens(pages)))
    hosts = work.save(hosts)
    templates = work.save(hosts.join(found, "host", "left").select("host", "classes"))
    read = work.save(read_templates(pages, templates))
    told = verdicts(hosts, templates, read)
    made = [T.StructField("text", T.StringType())]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, tuple] = {}
        for batch in pieces(batches, "html"):
            column = lambda name, k: batch.column(batch.schema.get_field_index(name))[k].as_py()  # noqa: B023,E731
            texts = []
            for k in range(batch.num_rows):
                host = column("host", k)
                if host not in known:
                    known[host] = tuple(frozenset(column(c, k) or ()) for c in ("tags", "words", "barred"))
                texts.append(_own_text(tokens(column("html", k) or ""), *known[host]))
            if len(known) > 256:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("row")), pa.array(texts, pa.string())], ["row", "text"])

    joined = measured_join(pages, told, ["host"], "html")
    schema = T.StructType([pages.schema["row"], *made])
    return joined.mapInArrow(run, schema).select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
