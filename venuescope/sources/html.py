"""Fields of web pages by selectors: pages to a table of tags, selectors as conditions on it.

A small machine runs once over each page and gives its elements in order: tag, attributes, depth, the place of the element
that holds it, and its text with entities resolved. It takes pages as they come: attributes in either quotes or none, in any
order and case; tags never closed, closed twice or in the wrong order (a closing tag ends what is open down to its partner,
or nothing); comments, scripts and styles, whose text is no text. A selector is `tag`, `.class`, `#id`, `[name]`,
`[name="value"]`, `[name^="start"]`, `[name*="part"]`, or several of these at once, and such parts with a blank between
for an element within another. A field has several selectors: the first with a text that is not blank gives it.

A null page is an empty one; a page without tags has no elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that hold nothing, those whose text is no text, and those that the next of their kind closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
SAME = frozenset("p li dt dd option tr td th".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([\^*]?=)\"([^\"]*)\")?\]")
BLANK = re.compile(r"[\t\n\f\r ]+")
#: Pages of a batch that is given back: what a task holds besides the batch that it reads.
PAGES = 256


def collapsed(text: str) -> str:
    """White space made single blanks, as pages are shown: a blank that does not break is none."""
    return BLANK.sub(" ", text).strip(" ")


class Element:
    """An element; its text is the run of its page's pieces between its tags, so that pieces are kept once, however deep."""

    __slots__ = ("tag", "attributes", "parent", "classes", "pieces", "first", "last")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, pieces: list[str]):
        self.tag, self.attributes, self.parent, self.pieces = tag, attributes, parent, pieces
        self.classes = frozenset(attributes.get("class", "").split())
        self.first, self.last = len(pieces), None

    def text(self, as_written: bool = False) -> str:
        whole = "".join(self.pieces[self.first : self.last])
        return whole if as_written else collapsed(whole)


def resolver(entities: dict[str, str] | None) -> Callable[[str], str]:
    """What resolves entities in a text: all that HTML knows, closed or not; or only the given ones, as they are written."""
    if entities is None:
        return unescape
    known = re.compile("|".join(map(re.escape, entities)))
    return lambda text: known.sub(lambda m: entities[m[0]], text)


def elements(page: str, as_written: bool = False, entities: dict[str, str] | None = None) -> list[Element]:
    """The elements of a page in the order of their opening tags; their texts with entities resolved, or as written."""
    out, open_, pieces, at, end = [], [], [], 0, len(page)
    resolved = resolver(entities)

    def said(text: str) -> None:
        if text and open_ and open_[-1].tag not in RAW:
            pieces.append(text if as_written else resolved(text))

    def closed() -> Element:
        own = open_.pop()
        own.last = len(pieces)
        return own

    while at < end:
        if open_ and open_[-1].tag in RAW:
            # A script ends at its own closing tag only, whatever stands in it.
            close = re.compile(rf"</{open_[-1].tag}\s*>", re.I).search(page, at)
            closed()
            at = close.end() if close else end
            continue
        found = TAG.search(page, at)
        said(page[at : found.start() if found else end])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if any(e.tag == tag for e in open_):
                while closed().tag != tag:
                    pass
            continue
        if tag in SAME and open_ and open_[-1].tag == tag:
            closed()
        values = {}
        for a in ATTRIBUTE.finditer(found[3]):
            values.setdefault(a[1].lower(), resolved(next((x for x in a.groups()[1:] if x is not None), "")))
        own = Element(tag, values, open_[-1] if open_ else None, pieces)
        out.append(own)
        if tag not in VOID and not found[3].rstrip().endswith("/"):
            open_.append(own)
        else:
            own.last = own.first
    return out


def parsed(selector: str) -> list[list[tuple]]:
    """A selector as its steps, each the conditions of one element."""
    steps = []
    for step in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector):
        parts = list(PART.finditer(step))
        if "".join(p[0] for p in parts) != step:
            raise ValueError(f"not a selector: {selector}")
        steps.append([p.groups() for p in parts])
    return steps


def _fits(e: Element, step: list[tuple]) -> bool:
    for tag, name, own_id, attribute, how, value in step:
        has = e.attributes.get(attribute) if attribute else None
        if tag and e.tag != tag.lower() or name and name not in e.classes or own_id and e.attributes.get("id") != own_id:
            return False
        if attribute and (has is None or how == "=" and has != value or how == "^=" and not has.startswith(value) or how == "*=" and value not in has):
            return False
    return True


def selected(e: Element, steps: list[list[tuple]]) -> bool:
    """Whether an element fits the last step, and elements around it the others, from the inside out."""
    if not _fits(e, steps[-1]):
        return False
    left, above = len(steps) - 2, e.parent
    while left >= 0 and above:
        left -= _fits(above, steps[left])
        above = above.parent
    return left < 0


def fields(pages: DataFrame, wanted: dict[str, list[str]], html: str = "html", counts: dict[str, str] | None = None, as_written: bool = False, entities: dict[str, str] | None = None) -> DataFrame:
    """pages with a column for every field of `wanted` and a number for every selector of `counts`.

    A field is the text of the first element of the first of its selectors that has one; `selector@name` takes an
    attribute in place of the text. Null where none has. as_written: texts keep their entities and white space. entities: resolve only these, as
    they are written, in place of all. Of each page only its fields are kept, and few pages are held at a time."""
    counts = counts or {}
    rules = {name: [(parsed(s.partition("@")[0]), s.partition("@")[2].lower()) for s in options] for name, options in wanted.items()}
    numbers = {name: parsed(s) for name, s in counts.items()}
    clash = {*wanted, *counts} & set(pages.columns)
    if clash:
        raise ValueError(f"pages have columns of these names: {sorted(clash)}")
    names, at = pages.columns, pages.columns.index(html)

    def first(found: list[Element], options: list[tuple]) -> str | None:
        for steps, attribute in options:
            for e in found:
                if selected(e, steps):
                    own = collapsed(e.attributes.get(attribute, "")) if attribute else e.text(as_written)
                    if own:
                        return own
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAGES):
                b = whole.slice(start, PAGES)
                texts, sums = [[] for _ in rules], [[] for _ in numbers]
                for page in b.column(at):
                    found = elements(page.as_py() or "", as_written, entities)
                    for out, options in zip(texts, rules.values(), strict=True):
                        out.append(first(found, options))
                    for out, steps in zip(sums, numbers.values(), strict=True):
                        out.append(sum(selected(e, steps) for e in found))
                told = [*(pa.array(x, pa.string()) for x in texts), *(pa.array(x, pa.int64()) for x in sums)]
                yield pa.RecordBatch.from_arrays([*b.columns, *told], [*names, *rules, *numbers])

    schema = pages.select("*", *(F.lit("").alias(n) for n in rules), *(F.lit(0).cast("long").alias(n) for n in numbers)).schema
    for f in schema.fields:
        f.nullable = True
    return pages.mapInArrow(run, schema)
