"""Plain XML documents read column by column (SRC-3).

Most documents that servers write are plain: elements, attributes in double quotes, text.  A batch of them is read with array
operations over its bytes (marks are found, the few different tag heads and attribute names are decoded once, values are slices), a
fraction of the work of an event parser.  A document is taken only if it is known to be well-formed and to mean what ``from_xml``
makes of it; any other (entities, comments, declarations, single quotes, other case of a name, numbers that are none, repeated single
elements, ...) is left, and the caller parses it with ``from_xml``.

The functions run on executors and are pickled by value, so workers need only public libraries.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOCUMENTS_EACH = 1_000  # documents read together
LONGEST = 400_000       # bytes of a document that is read here; the parser bounds the length of values
DEEPEST = 100           # levels
NAMES = 60              # different attribute names of documents read together

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_HEAD = re.compile(rf"(/?)({_NAME})(?:[ \t\n]*(/?)|[ \t\n]+({_NAME})[ \t\n]*(=)[ \t\n]*)")
_GAP = re.compile(rf"[ \t\n]+({_NAME})[ \t\n]*=[ \t\n]*")
_TAIL = re.compile(r"[ \t\n]*(/?)")


def compiled(schema: StructType, paths: list[tuple[str, ...]]) -> dict | None:
    """``schema`` as nodes, of plain values; None if it holds what is not read here.  ``paths``: elements that lead to the struct, from the root."""
    nodes: list[dict] = []

    def struct(kind) -> int:
        at = len(nodes)
        nodes.append({"fields": [], "kids": {}})
        for f in kind.fields:
            t, many = f.dataType, isinstance(f.dataType, ArrayType)
            t = t.elementType if many else t
            if f.name.startswith("_") and not many and isinstance(t, LongType | StringType):
                nodes[at]["fields"].append((f.name, "long" if isinstance(t, LongType) else "string", f.name[1:], None))
            elif isinstance(t, StructType) or (isinstance(t, StringType) and not many):
                if isinstance(t, StructType):
                    kid = struct(t)
                else:
                    kid = len(nodes)
                    nodes.append({"text": True, "kids": {}})
                nodes[kid]["many"] = many
                nodes[at]["kids"][f.name] = kid
                nodes[at]["fields"].append((f.name, "list" if many else "struct" if isinstance(t, StructType) else "text", f.name, kid))
            else:
                raise NotImplementedError(f.name)
        return at

    try:
        target = struct(schema)
    except NotImplementedError:
        return None
    top = len(nodes)
    nodes.append({"kids": {}, "many": False})
    for path in paths:
        here = top
        for name in path[:-1]:
            if name not in nodes[here]["kids"]:
                nodes[here]["kids"][name] = len(nodes)
                nodes.append({"kids": {}, "many": False})
            here = nodes[here]["kids"][name]
        nodes[here]["kids"][path[-1]] = target
    nodes[target]["many"] = False
    return {"nodes": nodes, "target": target, "top": top}


def _looks_like(name: str, known: set[str], lowered: set[str]) -> bool:
    """Whether a name that is not known may still be taken for one."""
    return name not in known and name.lower() in lowered


def _read(docs, plan):
    """Struct of the documents that are read (a ``pa.StructArray``) and their places; ``docs``: strings without NULL."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    nodes, target, top = plan["nodes"], plan["target"], plan["top"]
    tags_known = {k for n in nodes for k in n["kids"]}
    attributes_known = {x[2] for n in nodes for x in n.get("fields", ()) if x[1] in ("long", "string")}
    tags_lower, attributes_lower = ({x.lower() for x in s} for s in (tags_known, attributes_known))
    kinds = np.zeros(256, np.uint8)
    kinds[[ord(c) for c in "<>\""]] = 1
    kinds[[9, 10]] = 2                                              # white space that a value in an attribute must not hold
    kinds[[x for x in range(32) if x not in (9, 10)] + [0x26, 0x7F, 0xC2, 0xEF]] = 3    # entities; characters that may not be allowed

    some_kind = (kinds > 0).tobytes()
    place = np.arange(len(docs))
    lengths = pc.binary_length(docs).to_numpy(zero_copy_only=False)
    bad = (lengths < 4) | (lengths > LONGEST)
    while True:
        if bad.any():
            docs, place = docs.filter(pa.array(~bad)), place[~bad]
        n = len(docs)
        if not n:
            return None, place
        offsets = np.frombuffer(docs.buffers()[1], np.int32)[docs.offset:docs.offset + n + 1].astype(np.int64)
        data = np.frombuffer(docs.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        bad = (data[offsets[:-1]] != 60) | (data[offsets[1:] - 1] != 62)
        # marks: alternating < and >, attribute values between quotes inside of them
        at = np.flatnonzero(np.frombuffer(data.tobytes().translate(some_kind), np.bool_))
        kind = kinds[data[at]]
        if len(odd := at[kind == 3]):
            bad[np.searchsorted(offsets, odd, "right") - 1] = True
        if bad.any():
            continue
        marks = at[kind == 1]
        ch = data[marks]
        first = np.searchsorted(marks, offsets[:-1])
        doc_of_mark = np.repeat(np.arange(n), np.diff(np.append(first, len(marks))))
        quote, is_open = ch == 34, ch == 60
        quotes = np.cumsum(quote) - quote
        inside = (quotes - quotes[first][doc_of_mark]) & 1 == 1     # after an opening quote, up to the closing one
        angles = np.cumsum(~quote) - ~quote
        in_tag = (angles - angles[first][doc_of_mark]) & 1 == 1     # between < and >
        wrong = np.where(quote, ~in_tag, inside | (is_open == in_tag))
        bad[doc_of_mark[wrong]] = True
        if len(blank := at[kind == 2]) and not bad.any():
            left = np.searchsorted(marks, blank) - 1
            bad[doc_of_mark[left[quote[left] & ~inside[left]]]] = True
        if bad.any():
            continue

        # slices between marks are values, of which the markup's are few
        bounds = np.empty(2 * len(marks) - 1, np.int32)
        bounds[0::2], bounds[1::2] = marks + 1, marks[1:]
        bounds[-1] = marks[-1] + 1
        cut = pa.StringArray.from_buffers(2 * len(marks) - 2, pa.py_buffer(bounds), pa.py_buffer(data))

        def slices(x):
            return pc.take(cut, pa.array((2 * x).astype(np.int32)), boundscheck=False)

        def coded(x):
            e = slices(x).dictionary_encode()
            return e.indices.to_numpy(), e.dictionary.to_pylist()

        opens, closes = np.flatnonzero(is_open), np.flatnonzero(ch == 62)
        doc = doc_of_mark[opens]
        count = (closes - opens - 1) // 2
        tag_names: dict[str, int] = {}
        names: dict[str, int] = {}

        def of(name, table, known, lowered):
            return -1 if _looks_like(name, known, lowered) else table.setdefault(name, len(table))

        code, said = coded(opens)
        heads = np.full((len(said), 5), -1, np.int64)               # fits, kind (0 opens, 1 closes, 2 both), name, attribute, has one
        for k, x in enumerate(said):
            m = _HEAD.fullmatch(x)
            if m and not (m[1] and (m[3] or m[5])):
                tag = -1 if m[2].startswith("_") else of(m[2], tag_names, tags_known, tags_lower)
                a = of(m[4], names, attributes_known, attributes_lower) if m[5] else -1
                heads[k] = tag >= 0 and (not m[5] or 0 <= a < NAMES), 1 if m[1] else 2 if m[3] else 0, tag, a, bool(m[5])
        heads = heads[code]
        way, tag, has = heads[:, 1].copy(), heads[:, 2], count > 0
        bad[doc[(heads[:, 0] != 1) | ((heads[:, 4] == 1) != has)]] = True
        if has.any():
            code, said = coded(closes[has] - 1)
            tails = np.array([-1 if (m := _TAIL.fullmatch(x)) is None else 2 if m[1] else 0 for x in said])[code]
            bad[doc[has][tails < 0]] = True
            way[has] = tails
        quoted = np.flatnonzero(quote)[0::2]                        # opening quotes
        owner = np.repeat(np.arange(len(opens)), count)
        name = np.empty(len(quoted), np.int64)
        leads = is_open[quoted - 1]
        name[leads] = heads[has, 3]
        if not leads.all():
            code, said = coded(quoted[~leads] - 1)
            found = [-1 if (m := _GAP.fullmatch(x)) is None else of(m[1], names, attributes_known, attributes_lower) for x in said]
            name[~leads] = np.array(found)[code]
        bad[doc[owner[(name < 0) | (name >= NAMES)]]] = True
        if len(name) and not bad.any():                             # an attribute stands once
            bits = np.left_shift(1, name)
            starts = (np.cumsum(count) - count)[has]
            bad[doc[has][np.add.reduceat(bits, starts) != np.bitwise_or.reduceat(bits, starts)]] = True

        # one root; elements are closed in turn
        step = np.array([1, -1, 0])[way]
        depth = np.cumsum(step)
        start = np.searchsorted(opens, first)
        last = np.append(start[1:], len(opens)) - 1
        depth = depth - (depth[start] - step[start])[doc]
        ends = np.zeros(len(opens), bool)
        ends[last] = True
        bad[doc[(depth > DEEPEST) | np.where(ends, depth != 0, depth <= 0)]] = True
        if bad.any():
            continue
        level = depth + (way != 0)
        pairs = np.flatnonzero(way != 2)
        pairs = pairs[np.argsort(level[pairs].astype(np.int16), kind="stable")]
        bad[doc[pairs[0::2][tag[pairs[0::2]] != tag[pairs[1::2]]]]] = True
        if bad.any():
            continue

        # elements of the schema
        kid = np.full((len(nodes) + 1, len(tag_names) + 1), -1, np.int16)
        for k, x in enumerate(nodes):
            for t, to in x["kids"].items():
                if t in tag_names:
                    kid[k, tag_names[t]] = to
        node, parent = np.full(len(opens), -1, np.int16), np.full(len(opens), -1, np.int64)
        above = None
        for depth_now in range(1, int(level.max()) + 1):
            here = np.flatnonzero((level == depth_now) & (way != 1))
            if above is None:
                node[here] = kid[top, tag[here]]
                bad[doc[here[node[here] < 0]]] = True
            else:
                parent[here] = above[np.searchsorted(above, here) - 1]
                node[here] = kid[node[parent[here]], tag[here]]     # of none: the last row, which knows no name
            above = here[way[here] == 0]
            if not len(above):
                break
        text = closes[:-1][marks[opens[1:]] - marks[closes[:-1]] > 1]
        if len(text):
            text = text[pc.match_substring_regex(slices(text), r"[^ \t\n]").to_numpy(zero_copy_only=False)]
        said_after = np.zeros(len(opens), bool)                     # text that is more than white space follows
        said_after[np.searchsorted(closes, text)] = True
        is_text = np.array([x.get("text", False) for x in nodes] + [False])
        bare = np.array([not x["kids"] and "fields" in x for x in nodes] + [True])      # nothing inside is read
        after = np.flatnonzero(said_after)
        inner = after[way[after] == 0]
        outer = after[way[after] != 0]
        bad[doc[inner[~is_text[node[inner]] & ~bare[node[inner]]]]] = True
        for t in outer:                                             # rare: text behind an element
            up = np.flatnonzero((level[:t] == level[t] - 1) & (way[:t] == 0))
            if node[up[-1]] >= 0:
                bad[doc[t]] = True
        texts = np.flatnonzero((way != 1) & is_text[node])
        if len(texts):
            bad[doc[texts[(way[texts] != 0) | (count[texts] > 0) | ~said_after[texts]]]] = True
            whole = texts[way[texts] == 0]
            bad[doc[whole[way[whole + 1] != 1]]] = True
        leaf = np.flatnonzero((way == 0) & (node >= 0) & bare[node])
        bad[doc[leaf[way[leaf + 1] != 1]]] = True                   # elements inside of one that has none in the schema
        elements = np.flatnonzero((node >= 0) & (way != 1))
        elements = elements[np.argsort(node[elements], kind="stable")]
        by_node = np.split(elements, np.searchsorted(node[elements], np.arange(1, len(nodes), dtype=np.int16)))
        for k, x in enumerate(nodes):
            if k != top and not x["many"] and len(by_node[k]) > 1:
                up = np.where(parent[by_node[k]] < 0, -1 - doc[by_node[k]], parent[by_node[k]])
                bad[doc[by_node[k][1:][up[1:] == up[:-1]]]] = True
        if bad.any():
            continue

        # values of attributes by node and name
        lo, hi = marks[quoted] + 1, marks[quoted + 1]
        padded = bool((((data[lo] == 32) | (data[hi - 1] == 32)) & (hi > lo)).any())
        key = np.where(node[owner] >= 0, node[owner].astype(np.int16) * np.int16(64) + name.astype(np.int16), np.int16(-1))
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], np.arange(64 * len(nodes) + 1, dtype=np.int16))
        ordinal = np.empty(len(opens), np.int64)
        for x in by_node:
            ordinal[x] = np.arange(len(x))

        def spread(where, n):
            """Index of the ``n`` rows into values that stand at ``where``, NULL where none stands."""
            to = np.full(n, -1, np.int64)
            to[where] = np.arange(len(where))
            return pa.array(to, mask=to < 0)

        def attribute(k, x, long):
            a = names.get(x, 63)
            some = order[cuts[k * 64 + a]:cuts[k * 64 + a + 1]]
            v = slices(quoted[some])
            if padded:
                v = pc.ascii_trim(v, characters=" ")
            if long:
                plain = pc.match_substring_regex(v, r"^-?[0-9]{1,18}$").to_numpy(zero_copy_only=False)
                if not plain.all():
                    bad[doc[owner[some[~plain]]]] = True
                    return pa.nulls(len(by_node[k]), pa.int64())
                v = v.cast(pa.int64())
            return v if len(some) == len(by_node[k]) else v.take(spread(ordinal[owner[some]], len(by_node[k])))

        def build(k):
            out = []
            for field, kind, x, to in nodes[k]["fields"]:
                if kind in ("long", "string"):
                    out.append(attribute(k, x, kind == "long"))
                    continue
                inner = by_node[to]
                up = ordinal[parent[inner]]
                if kind == "list":
                    many = np.bincount(up, minlength=len(by_node[k]))
                    rows = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
                    out.append(pa.ListArray.from_arrays(rows, build(to), mask=pa.array(many == 0)))
                    continue
                v = pc.ascii_trim(slices(closes[inner]), characters=" \t\n") if kind == "text" else build(to)
                out.append(v if len(inner) == len(by_node[k]) else v.take(spread(up, len(by_node[k]))))
            kinds = [x[0] for x in nodes[k]["fields"]]
            return pa.StructArray.from_arrays(out, kinds) if out else pa.array([{}] * len(by_node[k]), pa.struct([]))

        got = build(target)
        if bad.any():
            continue
        return (got if len(got) == n else got.take(spread(doc[by_node[target]], n))), place


def read_plain(xml: Column, schema: StructType, paths: list[tuple[str, ...]]) -> Column | None:
    """``struct<read, found, left>``: whether the document was read, the ``schema`` struct at one of ``paths`` (NULL without such an
    element), and the document if it was not read; None if the schema holds what is not read here."""
    plan = compiled(schema, paths)
    if plan is None:
        return None
    out = StructType().add("read", "boolean").add("found", schema).add("left", "string")

    def run(docs):
        import numpy as np
        import pyarrow as pa

        kind = to_arrow_type(out)
        done = []
        docs = docs.cast(pa.string())
        for lo in range(0, len(docs), DOCUMENTS_EACH):
            some = docs.slice(lo, DOCUMENTS_EACH)
            valid = np.flatnonzero(some.is_valid().to_numpy(zero_copy_only=False))
            found, place = _read(some if len(valid) == len(some) else some.take(pa.array(valid)), plan)
            read = np.zeros(len(some), bool)
            if found is None:
                found = pa.nulls(len(some), kind.field("found").type)
            else:
                read[valid[place]] = True
                found = found.cast(kind.field("found").type)
                if len(place) < len(some):
                    to = np.full(len(some), -1, np.int64)
                    to[valid[place]] = np.arange(len(place))
                    found = found.take(pa.array(to, mask=to < 0))
            left = some.take(pa.array(np.arange(len(some)), mask=read))
            done.append(pa.StructArray.from_arrays([pa.array(read), found, left], fields=list(kind)))
        return pa.concat_arrays(done) if done else pa.nulls(0, kind)

    return F.arrow_udf(run, out, F.ArrowUDFType.SCALAR)(xml)
