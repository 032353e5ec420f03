"""Secret scans over a trigram inverted index.

Each rule is a regular expression over UTF-8 bytes.  Its syntax tree gives a
Boolean query of trigrams that every match must hold.  A batch of texts is
indexed by the trigrams that any rule asks for; each rule intersects and unites
postings and its expression is run on the candidates alone.  A rule without
mandatory trigrams runs on every text.

Defined results: null text is the empty text and has no spans; offsets count
code points, the end is exclusive; matches of one rule do not overlap, leftmost
first, and a match that fails its rule's check is dropped without a retry.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents

#: Strings that one exact set may hold before it becomes a query.
MOST_STRINGS = 64


class Rule:
    def __init__(self, kind: str, pattern: bytes, group: int = 0, least: int = 0):
        """A match counts if its group is ``least`` bytes long at least."""
        self.kind, self.pattern, self.group, self.least = kind, re.compile(pattern), group, least
        self.query = trigram_query(pattern)


def trigram_query(pattern: bytes):
    """True, a trigram (bytes, lower case), or ("and" | "or", parts)."""
    exact, query = _visit(_parser.parse(pattern))
    return _all([query, _of_strings(exact)])


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings):
    if not strings:
        return True
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _visit(items):
    """(set of all strings that the items can match, or None if unknown; query that holds besides)."""
    exact, parts = {b""}, []

    def end():
        nonlocal exact
        parts.append(_of_strings(exact))
        exact = {b""}

    whole = True
    for op, value in items:
        if op is C.LITERAL and value < 256:
            own, query = {bytes([value]).lower()}, True
        elif op is C.SUBPATTERN:
            own, query = _visit(value[3])
        elif op is C.BRANCH:
            branches = [_visit(b) for b in value[1]]
            if all(e is not None and q is True for e, q in branches):
                own, query = set().union(*(e for e, _ in branches)), True
            else:
                own, query = None, _any([_all([q, _of_strings(e)]) for e, q in branches])
        elif op is C.IN and all(o is C.LITERAL for o, _ in value):
            own, query = {bytes([v]).lower() for _, v in value}, True
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            e, q = _visit(inner)
            if low == 0:
                own, query = ({b""} | e, True) if high == 1 and e is not None and q is True else (None, True)
            else:
                own, query = (e, q) if low == high == 1 else (None, _all([q, _of_strings(e)]))
        else:
            own, query = None, True
        if own is not None and len(own) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in own}
            parts.append(query)
            continue
        whole = False
        end()
        parts.append(query)
        if own is not None:
            exact = own
    if whole:
        return exact, _all(parts)
    end()
    return None, _all(parts)


BASE = ("assign", "access", "hex")


def rules() -> list[Rule]:
    """The base rules, then those that the method adds.  The patterns are fixed values."""
    return [
        Rule("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
        Rule("hex", rb"[0-9a-f]+", 0, 24),
        Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
        Rule("hosting_token", rb"gh[opsu]_[A-Za-z0-9]{36}"),
        Rule("chat_token", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
        Rule("payment_key", rb"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
        Rule("web_token", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ]


#: A whole key: from its header to its END line, however far, which is looked for up to the next header (so each part of a text is read once); or its header, fields and base64 body when END is missing.
#: Signs of quoting, comments and escaped line ends may stand between the lines.
_GAP = rb"""(?:\\[nrt]|(?!-----)[\s"'\\,;+#*>|/-])*+"""
_FIELD = rb"""(?:[A-Za-z][A-Za-z-]*:\x20[^\r\n\\]*+)"""
KEY = (
    rb"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN |END [A-Z ]*PRIVATE KEY-----)))*+-----END [A-Z ]*PRIVATE KEY-----"
    rb"|(?:" + _GAP + _FIELD + rb")*+(?:" + _GAP + rb"[A-Za-z0-9+/]{16,}+={0,2})++(?:" + _GAP + rb"[A-Za-z0-9+/]++={0,2})?+(?:" + _GAP + rb"-----END [A-Z ]*PRIVATE KEY-----)?+)?"
)


def redacted() -> list[Rule]:
    """The rules by which texts are cleaned: a private key is a secret from its first line to its last, not its header alone."""
    return [Rule(r.kind, KEY) if r.kind == "private_key" else r for r in rules()]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Scanner:
    def __init__(self, own: list[Rule] | None = None):
        self.rules = own or rules()
        wanted: dict[bytes, int] = {}

        def collect(q):
            if isinstance(q, bytes):
                wanted.setdefault(q, len(wanted))
            elif q is not True:
                for p in q[1]:
                    collect(p)

        for r in self.rules:
            collect(r.query)
        self.wanted = wanted
        self.table = np.full(1 << 24, -1, np.int16)
        for t, k in wanted.items():
            self.table[int.from_bytes(t, "big")] = k
        # a long run of the class is one match; shorter runs need not be matched one by one
        self.full = [re.compile(rb"[0-9a-f]{%d,}" % r.least) if r.pattern.pattern == rb"[0-9a-f]+" else r.pattern for r in self.rules]

    def postings(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each wanted trigram, the texts that hold it."""
        flat = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        if len(flat) < 3:
            return [np.zeros(0, np.int64)] * len(self.wanted)
        code = flat[:-2].astype(np.int32) << 16
        code |= flat[1:-1].astype(np.int32) << 8
        code |= flat[2:]
        gram = self.table[code]
        at = np.flatnonzero(gram >= 0)
        ends = np.cumsum([len(t) for t in texts])
        doc = np.searchsorted(ends, at, "right")
        inside = at + 3 <= ends[doc]
        pairs = np.unique(gram[at[inside]].astype(np.int64) * len(texts) + doc[inside])
        edges = np.searchsorted(pairs, np.arange(len(self.wanted) + 1) * len(texts))
        return [pairs[a:b] - k * len(texts) for k, (a, b) in enumerate(zip(edges, edges[1:]))]

    def candidates(self, query, postings: list[np.ndarray], every: np.ndarray) -> np.ndarray:
        if query is True:
            return every
        if isinstance(query, bytes):
            return postings[self.wanted[query]]
        found = [self.candidates(q, postings, every) for q in query[1]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text, by start, then by the rules' order."""
        raw = [t or b"" for t in texts]
        postings, every = self.postings(raw), np.arange(len(raw))
        found: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        for k, (rule, pattern) in enumerate(zip(self.rules, self.full)):
            for d in self.candidates(rule.query, postings, every).tolist():
                for m in pattern.finditer(raw[d]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[d].append((m.start(), k, m.end()))
        out = []
        for text, spans in zip(raw, found):
            if not spans:
                out.append([])
                continue
            spans.sort()
            if text.isascii():
                out.append([(self.rules[k].kind, a, b) for a, k, b in spans])
                continue
            points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
            out.append([(self.rules[k].kind, int(points[a]), int(points[b])) for a, k, b in spans])
        return out


_SCANNER: dict[bool, Scanner] = {}


def _scanner(clean: bool = False) -> Scanner:
    if clean not in _SCANNER:
        _SCANNER[clean] = Scanner(redacted() if clean else rules())
    return _SCANNER[clean]


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found array of (kind, start, end)) of every row."""

    def run(batches):
        scanner = _scanner()
        for whole in batches:
            for b in slices(whole, 1, 2 << 20):
                found = scanner.scan(b.column(1).cast(pa.binary()).to_pylist())
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = [x for f in found for x in f]
                parts = [pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
                spans = pa.StructArray.from_arrays(parts, names=["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), spans)], names=["doc_id", "found"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; each secret of the text, with those that overlap it, is replaced by the mark."""
    at = df.columns.index(text_col)

    def run(batches):
        scanner = _scanner(True)
        for whole in batches:
            for b in slices(whole, at, 2 << 20):
                texts = b.column(at).to_pylist()
                for k, spans in enumerate(scanner.scan([t.encode() if t else None for t in texts])):
                    out, done = [], 0
                    for _, start, end in spans:
                        if start >= done:
                            out += [texts[k][done:start], mark]
                        done = max(done, end)
                    if spans:
                        texts[k] = "".join(out) + texts[k][done:]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    """The same spans by plain expressions: offsets are the lengths of what lies between matches, and of the matches, added up."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    plain = {"assign": rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""}
    columns, lists = [], []
    for k, r in enumerate(rules()):
        pattern = plain.get(r.kind, r.pattern.pattern.decode()).replace("'", "''")
        columns.append(f"regexp_extract_all(t, '{pattern}') AS m{k}, regexp_extract_all(t, '{pattern}', {r.group}) AS c{k}, string_split_regex(t, '{pattern}') AS g{k}")
        lists.append(
            f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'a': CAST(list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0) AS BIGINT), "
            f"'k': {k}, 'n': length(m{k}[i]), 'c': length(c{k}[i]), 'kind': '{r.kind}'}}), lambda x: x.c >= {r.least})"
        )
    text = lambda spans: f"array_to_string(list_transform({spans}, lambda x: x.kind || ':' || x.a || ':' || (x.a + x.n)), ',')"
    count = ", ".join(f"CAST(len(list_filter(found, lambda x: x.kind = '{b}')) AS BIGINT) AS n_{b}" for b in BASE)
    both = lists[0]
    for x in lists[1:]:
        both = f"list_concat({both}, {x})"
    return f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(columns)} FROM d),
s AS (SELECT doc_id, list_sort({both}) AS found FROM m)
SELECT doc_id, {count}, sha256(coalesce({text(f"list_filter(found, lambda x: x.k < {len(BASE)})")}, '')) AS base_sha256, coalesce({text('found')}, '') AS spans FROM s
"""


ORACLE_SQL = _sql()
