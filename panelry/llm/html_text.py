"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is a sequence of tokens: tags named by their path, and text nodes by path and content.
Tokens that occur equally often on the same pages of a host form an equivalence class; the vector
of occurrences is kept as a sum of hashes of (page, count), so a host of any size is one small
aggregation per token.  Classes are found on ``SUPPORT`` pages at least and need an element.

A valid class is ordered and nested.  Its tokens form a tree by the element of the class around
each; under every element, and among the tokens that have none, they must come in one order in
all occurrences.  Where they do not, they part: elements go on as classes of their own with what
is in them, text nodes alone are no class.  An element's members of its own class bound its slots.

A token found in several of these slots, in one of them on ``SUPPORT`` pages, has a role in each.
Tokens that are so told apart, and what lies in them, are counted again by role, and the classes of
the host are found anew, until no role is left in several slots: then the classes nest, each in a
slot of another, and that is the template.  Each round tells more roles apart, so the rounds end;
a host takes part only while it has such tokens.  A role that no slot holds on ``SUPPORT`` pages does
not nest.  Text nodes whose role is in a valid class are the template's own words, whatever part of
the host has that layout, and in that place only; what lies between template tokens is a slot.

The article is the slot that the article or main element encloses, or, on pages without one, the
slots whose enclosing tags are not page furniture.  Inside the element nothing is dropped for
being repeated, so copies of one article keep their text.  On other pages a block of template
words goes, unless only headings would be left.  Hosts of fewer than ``SUPPORT`` pages have no
template: there furniture is told by tags and names alone.

Furniture is told by tag and by the words of class, id and role.  Inside the article a name counts
only if all its parts are words of furniture or of layout.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import in_parts, written

SUPPORT = 8

#: Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split())
FURNITURE = frozenset(
    "nav header footer aside form script style noscript template head title iframe button select option textarea "
    "dialog menu svg canvas object label input".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
REPEATED = frozenset("li option tr td th dd dt".split())
SCOPE = frozenset("ul ol table dl select article section main div body aside nav".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner bar breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination "
    "pager popup promo promoted related reply replies respond search share sharing sidebar skip social sponsor "
    "sponsored subscribe subscription tags toolbar topbar widget widgets complementary contentinfo".split())
#: These do not tell furniture when a word for the article stands beside them.
WEAK_WORDS = frozenset("bar header notice respond search tags topbar".split())
MAIN_WORDS = frozenset("article content entry main post story body".split())

#: These make up names of boxes without saying what is in them.
LAYOUT_WORDS = frozenset(
    "area block bottom box col column container content group inner item items left link links list main module outer "
    "page panel row right section site slot top unit wrap wrapper zone".split())
#: Names that an article's own parts may bear alone.
OWN_WORDS = frozenset("bar header tags topbar".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)>?", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-zA-Z]+")
PARTS = re.compile(r"[-_0-9]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def is_furniture(tag: str, names: str, article: bool) -> bool:
    if tag in ("html", "body", "main", "article"):
        return False
    if tag == "header" and article:
        return False
    if tag in FURNITURE:
        return True
    if article:
        named = (set(PARTS.split(name.lower())) - {""} for name in names.split())
        return any(n <= FURNITURE_WORDS | LAYOUT_WORDS and n & (FURNITURE_WORDS - OWN_WORDS) for n in named)
    words = {w.lower() for w in WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names))}
    found = words & FURNITURE_WORDS
    return bool(found - WEAK_WORDS) or bool(found) and not words & MAIN_WORDS


def digest(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


class Text:
    """A text node: its block, its path, whether furniture, the article or a heading encloses it."""

    __slots__ = ("text", "block", "at", "path", "furniture", "article", "heading", "around", "role")

    def __init__(self, text, block, at, state):
        self.text, self.block, self.at = text, block, at
        _, self.path, self.furniture, self.article, self.heading, self.around = state
        self.role = None


def tokens(page: str) -> tuple[list[int], list[Text]]:
    """Template tokens of the tags, and the text nodes in page order."""
    return parsed(page)[:2]


def parsed(page: str) -> tuple[list[int], list[Text], list[int]]:
    """The tags, the text nodes, and for each tag the number of the tag around it, -1 without one.

    A text node has the number of tags before it and the number of the tag around it.

    A path is the hash of the path around it and the tag, so memory grows with the page and not
    with the depth of its tags.
    """
    tags, texts, around, stack, block = [], [], [], [], 0
    # stack: (tag, path, furniture, article, heading, number)
    outside = ("", 0, False, False, False, -1)
    state = outside

    def text(raw):
        if raw and not raw.isspace():
            texts.append(Text(html.unescape(raw), block, len(tags), state))
        elif raw:
            texts.append(Text(" ", block, len(tags), state))

    def close(upto):
        nonlocal state
        del stack[upto:]
        state = stack[-1] if stack else outside

    at = 0
    while True:
        found = TAG.search(page, at)
        text(page[at:found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        if found[0].startswith("<![CDATA["):
            text(html.escape(found[0][9:].removesuffix("]]>"), quote=False))
            continue
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in BLOCK:
                block += 1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            texts.append(Text(" ", block, len(tags), state))
            continue
        if tag in BLOCK:
            block += 1
            # an open paragraph, item or cell ends where the next block may not be inside it
            ends = {tag} & REPEATED | ({"p"} if tag in CLOSES_P or tag in REPEATED else set())
            last = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPE:
                    break
                if stack[k][0] in ends:
                    last = k
            if last is not None:
                close(last)
        names = " ".join(a or b or c for _, a, b, c in NAMED.findall(found[3])) if "=" in found[3] else ""
        article = state[3] or tag in ("article", "main")
        path = digest(f"{state[1]}/{tag}.{names}")
        tags.append(path)
        around.append(state[5])
        if tag in VOID or found[3].rstrip().endswith("/"):
            continue
        furniture, heading = state[2] or is_furniture(tag, names, article), state[4] or tag in HEADINGS
        stack.append((tag, path, furniture, article, heading, len(tags) - 1))
        state = stack[-1]
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
            at = end.start() if end else len(page)
    return tags, texts, around


def shown(text: str) -> str:
    return " ".join(text.split())


def text_token(node: Text) -> int:
    return digest(f"{node.path}#{shown(node.text)}")


def role_of(node: Text) -> int:
    """The role of a text node: its token until ``differentiated`` gives it another."""
    if node.role is None:
        node.role = text_token(node)
    return node.role


def in_template(node: Text) -> bool:
    """Text inside furniture is dropped anyway; only its tags matter."""
    return not node.furniture and bool(node.text.strip())


def host_of(url: str = "url") -> Column:
    """The host of an address in lower case, empty where there is none."""
    pattern = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
    return F.lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")))


def laid(tags: list[int], texts: list[Text], around: list[int], classes: dict[int, int]):
    """Where a page has its class tokens; ``classes`` tells the class of each role.

    A list in page order of the text node, None for a tag, the number of the tag, the class, the
    number of the element of its class around it, that of the nearest element of any class around
    it, -1 without one, and the member of that element's class before it, 0 without one.  Then for
    each tag its members: the roles of its class in it.
    """
    own = [classes.get(t) for t in tags]
    near: list[int] = []  # the nearest element of a class, the tag itself included
    members: list[list[int]] = [[] for _ in tags]
    opened: dict[int, list[int]] = {}
    stack: list[int] = []
    out = []

    def put(node, k, role, kind, outer):
        while stack and stack[-1] != outer:
            opened[own[stack.pop()]].pop()
        inside = opened.get(kind)
        up = inside[-1] if inside else -1
        before = members[outer][-1] if outer >= 0 and members[outer] else 0
        out.append((node, k, kind, up, outer, before))
        if up >= 0:
            members[up].append(role)

    plain = (t for t in texts if in_template(t))
    node = next(plain, None)
    for k in range(len(tags) + 1):
        while node and node.at <= k:
            role = role_of(node)
            if role in classes:
                put(node, -1, role, classes[role], near[node.around] if node.around >= 0 else -1)
            node = next(plain, None)
        if k == len(tags):
            break
        outer = near[around[k]] if around[k] >= 0 else -1
        near.append(outer if own[k] is None else k)
        if own[k] is not None:
            put(None, k, tags[k], own[k], outer)
            opened.setdefault(own[k], []).append(k)
            stack.append(k)
    return out, members


def differentiated(page: str, rounds) -> tuple[list[int], list[Text], list[int]]:
    """A page as ``parsed`` gives it, with the roles after ``rounds`` of classes for the tokens.

    A round is the class of each role, the elements that have slots, and the roles to be told apart
    by slot.  A token's next role is made of its role, the next role of the element around it, of
    its own class if it has one there, and of its slot if it is to be told apart.
    """
    tags, texts, around = parsed(page)
    for classes, slotted, parted in rounds:
        roles = list(tags)
        for node, k, _, up, outer, before in laid(tags, texts, around, classes)[0]:
            role = node.role if node else tags[k]
            if up >= 0:
                role = digest(f"{role}@{roles[up]}")
            elif outer >= 0:
                slot = before if role in parted and tags[outer] in slotted else 0
                role = digest(f"{role}@{roles[outer]}/{slot}")
            if node:
                node.role = role
            else:
                roles[k] = role
        tags = roles
    return tags, texts, around


def rounds_of(given):
    """``rounds`` of a host by row number, unpacked once a host."""
    hosts, packed, held = given.column("host"), given.column("rounds"), {}

    def unpacked(i):
        host = hosts[i].as_py()
        if host not in held:
            held[host] = [(dict(zip(r["roles"], r["kinds"])), set(r["slotted"]), set(r["parted"]))
                          for r in packed[i].as_py() or ()]
        return held[host]

    return unpacked


def occurrence_rows(batches):
    """Per host and role the xor of hashes of (page, count), folded within a batch."""
    from collections import Counter

    import pyarrow as pa

    for given in in_parts(batches, "html"):
        held: dict[tuple[str, int, bool], list[int]] = {}
        rounds = rounds_of(given)
        for i, (row, host, page) in enumerate(zip(*(given.column(c).to_pylist() for c in ("row", "host", "html")))):
            tags, texts, _ = differentiated(page, rounds(i))
            plain = Counter(role_of(t) for t in texts if in_template(t))
            for is_text, counts in ((False, Counter(tags)), (True, plain)):
                for token, n in counts.items():
                    own = held.setdefault((host, token, is_text), [0, 0])
                    own[0] ^= digest(f"{row}:{n}")
                    own[1] += 1
        if held:
            hosts, names, kinds = zip(*held)
            vectors, pages = zip(*held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts), pa.array(names, pa.int64()), pa.array(kinds, pa.bool_()),
                 pa.array(vectors, pa.int64()), pa.array(pages, pa.int64())],
                names=["host", "token", "is_text", "vector", "pages"])


#: Kinds of rows about the places of class tokens.
ORDER, SLOT, PLACE = range(3)


def places(page: str, rounds, classes: dict[int, int]) -> tuple[dict[int, set[int]], set[tuple[int, int, int]], set[tuple[int, int, int]]]:
    """Where a page has its class tokens; ``classes`` tells the class of each role.

    Orders: per element, or per class for tokens without an element of it around them, the digests
    of the sequences found there.  Slots: such a token, the nearest element of a class around it,
    and the member of that element's class before it.  Places of text nodes: the role, the element
    or class whose sequence holds it, and the outermost token of its class around it.
    """
    tags, texts, around = differentiated(page, rounds)
    lying, members = laid(tags, texts, around, classes)
    top = list(tags)
    roots: dict[int, list[int]] = {}
    slots, found = set(), set()
    for node, k, kind, up, outer, before in lying:
        role = node.role if node else tags[k]
        if up < 0:
            roots.setdefault(kind, []).append(role)
            slots.add((role, tags[outer] if outer >= 0 else 0, before))
        elif not node:
            top[k] = top[up]
        if node:
            found.add((role, kind, role) if up < 0 else (role, tags[up], top[up]))
    orders: dict[int, set[int]] = {}
    for token, below in zip(tags, members):
        if token in classes:
            orders.setdefault(token, set()).add(sequence(below))
    for kind, row in roots.items():
        one = row[:len(set(row))]
        # as often as the class occurs, the same again
        orders[kind] = {sequence(one)} if one * (len(row) // len(one)) == row else {0, 1}
    return orders, slots, found


def sequence(tokens: list[int]) -> int:
    return digest(",".join(map(str, tokens))) if tokens else 0


def place_rows(batches):
    """The places of class tokens per host, folded within a batch."""
    from collections import Counter

    import pyarrow as pa

    for given in in_parts(batches, "html"):
        orders: dict[tuple[str, int], list[int]] = {}
        slots, found = Counter(), set()
        host_now, classes, rounds = None, {}, rounds_of(given)
        members, kinds = given.column("members"), given.column("kinds")
        for i, (host, page) in enumerate(zip(given.column("host").to_pylist(), given.column("html").to_pylist())):
            if host != host_now:
                host_now, classes = host, dict(zip(members[i].as_py(), kinds[i].as_py()))
            here, lying, placed = places(page, rounds(i), classes)
            for key, digests in here.items():
                kept = orders.setdefault((host, key), [min(digests), max(digests)])
                kept[0], kept[1] = min(kept[0], *digests), max(kept[1], *digests)
            slots.update((host, *slot) for slot in lying)
            found.update((host, *place) for place in placed)
        rows = [(host, ORDER, key, 0, 0, low, high, 0) for (host, key), (low, high) in orders.items()]
        rows += [(host, SLOT, token, outer, slot, 0, 0, n) for (host, token, outer, slot), n in slots.items()]
        rows += [(host, PLACE, token, part, top, 0, 0, 0) for host, token, part, top in found]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                names=["host", "kind", "token", "part", "slot", "low", "high", "pages"])


#: What leads from tokens to roles, a round of classes each.
ROUNDS = "array<struct<roles: array<long>, kinds: array<long>, slotted: array<long>, parted: array<long>>>"


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``host``, ``frame``, ``rounds``: the roles of text nodes in the valid classes of a host.

    A class is all roles with one occurrence vector, on ``support`` pages at least; it is valid
    if it holds an element and is ordered and nested.  A frame holds only texts that as many pages
    of its host share in one place.  ``rounds`` lead from the tokens of a page to their roles, see
    ``differentiated``; a host whose tokens have one role each has none.
    """
    known, done, nothing = None, None, F.array().cast("array<long>")
    while True:
        given = pages.select("host", "html")
        given = given.withColumn("rounds", F.lit(None).cast(ROUNDS)) if known is None else given.join(known, "host")
        counts = given.withColumn("row", F.monotonically_increasing_id()).select("row", "host", "html", "rounds").mapInArrow(
            occurrence_rows, "host string, token long, is_text boolean, vector long, pages long")
        wide = written(counts.groupBy("host", "token", "is_text").agg(
            F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages")).where(F.col("pages") >= support), "tokens")
        elements, texts = wide.where("NOT is_text"), wide.where("is_text")
        # hosts without such texts need no tags either
        members = texts.unionByName(elements.join(texts.select("host").distinct(), "host", "left_semi"))
        listed = written(members.groupBy("host").agg(F.collect_list(
            F.struct("token", F.xxhash64("vector", "pages").alias("kind"))).alias("m")).select(
            "host", F.col("m.token").alias("members"), F.col("m.kind").alias("kinds")), "members")
        found = given.join(listed, "host").mapInArrow(
            place_rows, "host string, kind int, token long, part long, slot long, low long, high long, pages long")
        layout = written(found.groupBy("host", "kind", "token", "part", "slot").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages")), "layout")
        ordered = layout.where((F.col("kind") == ORDER) & (F.col("low") == F.col("high"))).select(
            "host", F.col("token").alias("part"))
        # an element whose own members come in no order has no slots
        slots = layout.where(F.col("kind") == SLOT).join(
            ordered.withColumn("slotted", F.lit(True)), ["host", "part"], "left").groupBy(
            "host", "token", "part", "slotted", F.when(F.col("slotted"), F.col("slot")).alias("slot")).agg(
            F.max("pages").alias("pages"))
        parted = slots.groupBy("host", "token").agg(F.count("*").alias("n"), F.max("pages").alias("pages")).where(
            (F.col("n") > 1) & (F.col("pages") >= support))
        # the hosts that go on, with one more round
        told = listed.join(parted.groupBy("host").agg(F.collect_list("token").alias("parted")), "host").join(
            ordered.groupBy("host").agg(F.collect_list("part").alias("slotted")), "host", "left")
        one = F.array(F.struct(
            F.col("members").alias("roles"), "kinds", F.coalesce("slotted", nothing).alias("slotted"), "parted")).cast(ROUNDS)
        if known is not None:
            told, one = told.join(known, "host"), F.concat("rounds", one)
        later = written(told.select("host", one.alias("rounds")), "rounds")
        # in the others every role has one slot; texts whose class has no element are no template
        nested = slots.where((F.col("pages") >= support) | F.col("slotted").isNull()).select(
            "host", F.col("token").alias("slot"))
        words = texts.join(elements.select("host", "vector", "pages").distinct(), ["host", "vector", "pages"], "left_semi")
        frames = layout.where(F.col("kind") == PLACE).join(ordered, ["host", "part"], "left_semi").join(
            nested, ["host", "slot"], "left_semi").join(words, ["host", "token"], "left_semi").join(
            later, "host", "left_anti").groupBy("host").agg(F.collect_set("token").alias("frame"))
        frames = frames.withColumn("rounds", F.lit(None).cast(ROUNDS)) if known is None else frames.join(known, "host")
        done = frames if done is None else done.unionByName(frames)
        if later.isEmpty():
            return written(done, "frames")
        known = later


def main_text(texts: list[Text], frame: set[int]) -> str:
    """The slots of the article, block by block."""
    inside = [t for t in texts if not t.furniture]
    if any(t.article and t.text.strip() for t in inside):
        inside = [t for t in inside if t.article]
    elif frame:
        free = [t for t in inside if t.text.strip() and role_of(t) not in frame]
        if not all(t.heading for t in free):
            # a block goes when all its text is template; inside other blocks the words stay
            live = {t.block for t in free}
            inside = [t for t in inside if t.block in live]
    blocks: dict[int, list[str]] = {}
    for t in inside:
        blocks.setdefault(t.block, []).append(t.text)
    return "\n\n".join(b for b in (shown("".join(parts)) for parts in blocks.values()) if b)


def extracted(batches):
    import pyarrow as pa

    for given in in_parts(batches, "html"):
        out, rounds = [], rounds_of(given)
        for i, (page, frame) in enumerate(zip(given.column("html").to_pylist(), given.column("frame").to_pylist())):
            out.append(main_text(differentiated(page, rounds(i) if frame else ())[1], set(frame or ())))
        yield pa.RecordBatch.from_arrays(
            [given.column("page_id"), given.column("url"), pa.array(out, pa.string()),
             pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars`` (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by a blank line.  Null and empty html give an empty text; pages whose url has no host
    form one site; repeated rows are pages of their own; further columns are ignored; an empty
    table gives an empty result.
    """
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                         F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    rows = plain.join(templates(plain, support), "host", "left").select("page_id", "url", "html", "host", "frame", "rounds")
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
