"""Legislative XML by events: a stack of open elements, and no tree.

A document is read twice. The first reading checks it and keeps what rows need before it can be known: whether there is a
<main>, which siblings lose to a later one of the same path, and numbers that come after children. The second reading gives a row for
each element when it ends, so texts that follow the children are known. Memory goes with the depth and with the children of the
elements that are open, not with the document; markup below them is passed over. Document type declarations are refused, so no
entity can expand.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from .. import schema

#: Elements in each other. A row names all that are above it, so deeper trees would give rows of any size.
MAX_DEPTH = 4_096
BYTES = 1 << 16
_QUOTES = str.maketrans("‘’“”", "''\"\"")
_ENDED = ("repealed", "reserved")
_PARTS = {"meta": ("type", "docNumber", "congress"), "preface": ("docNumber",)}


class UslmError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def kind_of(tag: str) -> str:
    low = tag.lower()
    return low if low in schema.ELEMENT_TYPES else schema.DOCUMENT_ALIASES.get(low, "unknown")


def straight(text: str | None) -> str | None:
    return text.translate(_QUOTES) if text else None


def events(xml: str | bytes | memoryview | None, handler) -> Iterator[None]:
    """Feed a document to handler.start(name, attributes), .end(), .text(data) and .mark() (a comment or instruction); stops after
    each part, so that the caller can take what there is."""
    if xml is None:
        raise UslmError("xml", "no document")
    raw = memoryview(xml.encode("utf-8", "surrogatepass") if isinstance(xml, str) else xml)
    parser = expat.ParserCreate("utf-8", "}")
    parser.buffer_text = True
    parser.StartElementHandler = lambda tag, attributes: handler.start(tag.rpartition("}")[2], attributes)
    parser.EndElementHandler = lambda tag: handler.end()
    parser.CharacterDataHandler = handler.text
    parser.CommentHandler = lambda data: handler.mark()
    parser.ProcessingInstructionHandler = lambda target, data: handler.mark()
    parser.StartDoctypeDeclHandler = _refused
    try:
        for at in range(0, len(raw), BYTES):
            parser.Parse(bytes(raw[at : at + BYTES]), False)
            yield
        parser.Parse(b"", True)
        yield
    except expat.ExpatError as e:
        raise UslmError("xml", str(e)) from None


def _refused(*_) -> None:
    raise UslmError("xml", "document type declarations are refused")


class Field:
    """A child of which the text before its first markup counts."""

    __slots__ = ("name", "text", "value", "open")

    def __init__(self, name: str, value: str | None = None):
        self.name, self.value, self.text, self.open = name, value, None, True


class Part:
    """A child whose own children are fields."""

    __slots__ = ("name", "fields")

    def __init__(self, name: str):
        self.name, self.fields = name, {}


class Credit:
    """References of a <sourceCredit>, grouped by the semicolons between them."""

    __slots__ = ("groups", "group", "depth", "ref")

    def __init__(self):
        self.groups, self.group, self.depth, self.ref = [], [], 0, None

    def run(self, text: str) -> None:
        """A run of text between two marks; the first one in a reference describes it."""
        if self.ref is not None:
            self.group.append({"ref_id": self.ref, "description": text})
            self.ref = None
        if ";" in text and self.group:
            self.groups.append(self.group)
            self.group = []


class Element:
    __slots__ = ("kind", "index", "parent", "attributes", "fields", "parts", "credits", "last", "children", "late", "head", "place", "shadowed")

    def __init__(self, kind: str, index: int, parent: Element | None, attributes: dict):
        self.kind, self.index, self.parent, self.attributes = kind, index, parent, attributes
        self.fields: dict[str, Field] = {}
        self.parts: dict[str, Part] = {}
        self.credits: list[dict] = []
        self.last: dict[str, int] = {}
        self.children, self.late, self.head = 0, False, None
        self.place, self.shadowed = [], False

    def part(self, name: str, field: str) -> str | None:
        if name not in self.parts or field not in self.parts[name].fields:
            raise UslmError("missing", f"<{field if name in self.parts else name}>")
        return self.parts[name].fields[field].text

    def number(self) -> tuple[str, str] | None:
        """(value, display) by what has been read so far; None if nothing names it."""
        num = self.fields.get("num")
        if num is not None:
            return num.value or "", num.text or ""
        if self.kind == "uscodedocument":
            return self.part("meta", "docNumber") or "", ""
        if self.kind == "publiclawdocument":
            return f"{self.part('meta', 'congress') or ''}-{self.part('meta', 'docNumber') or ''}", ""
        own = self.attributes.get("id")
        return (own, f"Level {own}") if self.kind == "level" and own is not None else None


class Main:
    """The <main> of a document, whose children are the document's."""

    __slots__ = ("of",)

    def __init__(self, of: Element):
        self.of = of


class Reader:
    """What both readings have in common: which tag is what."""

    def __init__(self, max_depth: int):
        self.stack: list = []
        self.max_depth, self.open, self.count = max_depth, 0, 0
        self.top: Element | None = None
        self.root_name: str | None = None
        self.held: list[str] = []
        self.wanted = False

    # texts
    def text(self, data: str) -> None:
        if self.wanted:
            self.held.append(data)

    def mark(self) -> None:
        """A run of text ends here."""
        if self.wanted:
            node, text = self.stack[-1], "".join(self.held)
            if isinstance(node, Field):
                node.text, node.open = straight(text), False
            else:
                node.run(text)
            self.held.clear()
            self._want()

    def _want(self) -> None:
        node = self.stack[-1] if self.stack else None
        self.wanted = isinstance(node, Credit) or (isinstance(node, Field) and node.open)

    # elements
    def start(self, tag: str, attributes: dict) -> None:
        above = self.stack[-1] if self.stack else None
        if above is None and self.top is not None:  # below what doesn't count
            self.stack.append(None)
            return
        self.mark()
        self.root_name = self.root_name or tag
        node = None
        if self.top is None:
            if tag in ("uscDoc", "pLaw"):
                node = self.top = self.begin(kind_of(tag), None, attributes)
        elif isinstance(above, Credit):
            above.depth += 1
            if tag == "ref":
                above.ref = attributes.get("href")
            self.wanted = True
            return
        elif isinstance(above, Part):
            if tag in _PARTS[above.name] and tag not in above.fields:
                node = above.fields[tag] = Field(tag)
        elif isinstance(above, Element | Main):
            node = self.child(above, tag, attributes)
        self.stack.append(node)
        self._want()

    def child(self, above: Element | Main, tag: str, attributes: dict):
        kind = kind_of(tag)
        if kind != "unknown" and attributes.get("status") not in _ENDED:
            parent = above.of if isinstance(above, Main) else above
            return self.begin(kind, parent, attributes) if self.takes(above) else None
        if isinstance(above, Main):
            return None
        if tag == "num" or tag in schema.TEXT_FIELDS:
            if tag not in above.fields:
                above.fields[tag] = Field(tag, attributes.get("value"))
                return above.fields[tag]
        elif tag in _PARTS:
            if tag not in above.parts and above.kind in ("uscodedocument", "publiclawdocument"):
                above.parts[tag] = Part(tag)
                return above.parts[tag]
        elif tag == "sourceCredit":
            return Credit()
        elif tag == "main" and above is self.top and above.kind == "uscodedocument":
            return self.main(above)
        return None

    def end(self) -> None:
        node = self.stack[-1]
        if node is None:
            self.stack.pop()
            return
        self.mark()
        if isinstance(node, Credit) and node.depth:
            node.depth -= 1
            return
        self.stack.pop()
        if isinstance(node, Credit):
            if node.group:
                node.groups.append(node.group)
            self.stack[-1].credits += [{"ref_pairs": g} for g in node.groups]
        elif isinstance(node, Element):
            self.open -= 1
            self.finish(node)
        self._want()

    def begin(self, kind: str, parent: Element | None, attributes: dict) -> Element:
        self.open += 1
        if self.open > self.max_depth:
            raise UslmError("unable_to_parse_element", f"more than {self.max_depth} elements in each other")
        node = Element(kind, self.count, parent, attributes)
        self.count += 1
        if parent is not None:
            self.place(node, parent)
        return node


class Outline(Reader):
    """The first reading."""

    def __init__(self, max_depth: int):
        super().__init__(max_depth)
        self.has_main = False
        self.losers: set[int] = set()
        self.numbers: dict[int, tuple[str, str]] = {}
        self.document: dict = {}
        self.outside: UslmError | None = None

    def takes(self, above: Element | Main) -> bool:
        return True

    def main(self, top: Element) -> Main | None:
        first, self.has_main = not self.has_main, True
        if first:  # what lay outside it counts no more
            top.last, self.losers, self.numbers, self.count, self.outside = {}, set(), {}, 1, None
        return Main(top) if first else None

    def place(self, node: Element, parent: Element) -> None:
        parent.late |= "num" not in parent.fields

    def child(self, above, tag, attributes):
        if self.has_main and above is self.top and kind_of(tag) != "unknown" and self.top.kind == "uscodedocument":
            return None
        return super().child(above, tag, attributes)

    def finish(self, node: Element) -> None:
        if node is self.top:
            self.document = self.checked(node)
            return
        try:
            number = node.number()
            if number is None:
                raise UslmError("unable_to_parse_element", f"{node.kind}: no number")
            if node.kind not in ("level", "publiclawdocument") and node.attributes.get("identifier") is None:
                raise UslmError("unable_to_parse_element", f"{node.kind}: no identifier")
        except UslmError as e:
            if self.has_main or self.top.kind != "uscodedocument":
                raise
            self.outside = self.outside or e  # an error only if no <main> follows
            return
        if node.late:
            self.numbers[node.index] = number
        own = f"{node.kind}_{number[0]}"
        if own in node.parent.last:
            self.losers.add(node.parent.last[own])
        node.parent.last[own] = node.index

    def checked(self, top: Element) -> dict:
        """What is known of the whole document."""
        if self.outside is not None:
            raise self.outside
        if top.kind == "publiclawdocument":
            self.numbers[0] = top.number()
            return {"kind": "bill", "usc_type": None, "bill_type": "public_law", "bill_id": top.part("preface", "docNumber")}
        named = (top.part("meta", "type") or "").lower()
        if named not in ("usctitle", "usctitleappendix"):
            raise UslmError("unknown_document_type", named)
        self.numbers[0] = top.number() if "docNumber" in top.parts["meta"].fields else ("", "")
        return {"kind": "us_code", "usc_type": "us_code", "bill_type": None, "bill_id": None}


class Rows(Reader):
    """The second reading: rows of ended elements come to `out`."""

    def __init__(self, outline: Outline):
        super().__init__(outline.max_depth)
        self.known, self.inside = outline, False
        self.out: list[dict] = []

    def takes(self, above: Element | Main) -> bool:
        return not (self.known.has_main and above is self.top)

    def main(self, top: Element) -> Main | None:
        first, self.inside = not self.inside, True
        return Main(top) if first else None

    def place(self, node: Element, parent: Element) -> None:
        node.place = [*parent.place, parent.children]
        parent.children += 1
        node.shadowed = parent.shadowed or node.index in self.known.losers
        self.heading(parent)

    def heading(self, node: Element) -> dict:
        """The columns that children need; the number is read by now, or was kept by the first reading."""
        if node.head is None:
            number = self.known.numbers.get(node.index) or node.number()
            own = "uscode" if node is self.top and node.kind == "uscodedocument" else f"{node.kind}_{number[0]}"
            above = self.heading(node.parent) if node.parent is not None else None
            name = "US Code" if own == "uscode" and above is None else f"{above['verbose_name']} {number[1]}" if above else number[1]
            node.head = {
                "path": f"{above['path']}/{own}" if above else own, "parent_path": above["path"] if above else None, "ancestor_paths": [*above["ancestor_paths"], above["path"]] if above else [],
                "number_value": number[0], "number_display": number[1], "verbose_name": name,
            }
        return node.head

    def finish(self, node: Element) -> None:
        whole = node is self.top and node.kind == "uscodedocument"
        text = {f: node.fields[f].text if f in node.fields and not whole else None for f in schema.TEXT_FIELDS}
        head = self.heading(node)
        own = node.attributes.get("identifier") or (f"/us/pl/{head['number_value']}" if node.kind == "publiclawdocument" else None)
        self.out.append({
            **head, "depth": len(node.place), "ordinal": node.place[-1] if node.place else 0, "ord_path": node.place, "shadowed": node.shadowed, "element_type": node.kind, "document_type": self.known.document,
            **text, "uslm_id": None if whole or node.kind == "level" else own, "uslm_uuid": None if whole else node.attributes.get("id"), "source_credits": [] if whole else node.credits,
        })
        if node.parent is not None:
            node.parent = None


def elements(xml: str | bytes | memoryview | None, max_depth: int = MAX_DEPTH) -> Iterator[dict]:
    """Rows of a document's elements, without snapshot_date; errors come before the first row."""
    outline = Outline(max_depth)
    for _ in events(xml, outline):
        pass
    if outline.top is None:
        raise UslmError("unsupported_document_type", outline.root_name or "")
    reader = Rows(outline)
    for _ in events(xml, reader):
        yield from reader.out
        reader.out.clear()


class Instructions:
    """Texts and actions of the elements with role "instruction", which may lie in each other."""

    def __init__(self):
        self.stack: list[dict | None] = []
        self.open: list[dict] = []
        self.rows: list[dict] = []

    def mark(self) -> None:
        pass

    def text(self, data: str) -> None:
        if self.open:
            self.open[-1]["texts"].append(data)

    def start(self, tag: str, attributes: dict) -> None:
        own = None
        if attributes.get("role") == "instruction":
            own = {"texts": [], "names": [], "ordinal": len(self.rows)}
            self.rows.append(own)
            self.open.append(own)
        self.stack.append(own)
        if self.open and tag.lower() == "amendingaction":
            if "type" not in attributes:
                raise UslmError("missing", "type of amendingAction")
            low = attributes["type"].lower()
            self.open[-1]["names"].append(schema.ACTION_ALIASES.get(low, low))

    def end(self) -> None:
        own = self.stack.pop()
        if own is None:
            return
        self.open.pop()
        text = "".join(own["texts"])
        if self.open:
            self.open[-1]["texts"].append(text)
            self.open[-1]["names"] += own["names"]
        own["texts"] = text


def instructions(xml: str | bytes | memoryview | None) -> list[dict]:
    """The amendments of a bill, in document order."""
    reader = Instructions()
    for _ in events(xml, reader):
        pass
    return [{"action_types": [n for n in r["names"] if n in schema.ACTIONS], "amending_text": r["texts"].translate(_QUOTES), "ordinal": r["ordinal"]} for r in reader.rows]
