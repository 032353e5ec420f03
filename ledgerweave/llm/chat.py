"""Chat formatting: records of many layouts become canonical turns by schema fingerprint.

A record (a JSON object) is described by its nested field paths; the hash of
the sorted paths selects a declarative mapping, which says where turns, roles
and texts are.  A turn is written as ``### role:`` newline text ``</turn>``
newline; inside roles and texts every character that a mark could begin with is
preceded by a backslash, so the marks are unambiguous and the text comes back
unchanged.  The loss mask covers the assistant's (escaped) texts.

Turns are formatted one by one; a conversation's digests are taken from its
turns in order, streamed, so that a long conversation is never held at once.

Defined results: null text or role is the empty string; turns are ordered by
turn number, then place in the record, role and text (null numbers first);
equal rows are separate turns; a record whose layout is unknown, or that is not
an object, gives no turns and is reported by ``unknown_layouts``.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that say nothing about the layout.
IGNORED = {"id", "conv_id", "source", "lang", "meta", "metadata", "split", "turn"}
#: Role names of other layouts (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "prompter": "user"}
LOSS_ROLE = "assistant"
_SPECIAL = re.compile(r"([\\#<:\n])")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]+|\\.)*)</turn>\n", re.S)
TURN_SCHEMA = "conv_id long, turn long, place int, role string, text string"
PIECE_SCHEMA = "conv_id long, turn long, place int, piece string, loss_start int, loss_end int"


def field_paths(value, path: str = "") -> set[str]:
    """Paths of all leaves; list items share their list's path and []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if path or k not in IGNORED for p in field_paths(v, f"{path}.{k}" if path else k)} or {path}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layouts: (paths, paths that may be absent, mapping).  A mapping lists steps: ("field", path, role), or
#: ("list", path, role field, text field), or ("pairs", path, ((field, role), ...)); "first, second" joins two fields.
LAYOUTS = [
    ({"role", "text"}, set(), [("self", "role", "text")]),
    ({"role", "content"}, set(), [("self", "role", "content")]),
    ({"messages[].role", "messages[].content"}, {"system"}, [("field", "system", "system"), ("list", "messages", "role", "content")]),
    ({"messages[].role", "messages[].text"}, {"system"}, [("field", "system", "system"), ("list", "messages", "role", "text")]),
    ({"conversations[].from", "conversations[].value"}, {"system"}, [("field", "system", "system"), ("list", "conversations", "from", "value")]),
    ({"instruction", "output"}, {"input", "system"}, [("field", "system", "system"), ("field", "instruction,input", "user"), ("field", "output", "assistant")]),
    ({"prompt", "completion"}, {"system"}, [("field", "system", "system"), ("field", "prompt", "user"), ("field", "completion", "assistant")]),
    ({"prompt", "response"}, {"system"}, [("field", "system", "system"), ("field", "prompt", "user"), ("field", "response", "assistant")]),
    ({"question", "answer"}, {"context"}, [("field", "context,question", "user"), ("field", "answer", "assistant")]),
    ({"turns[].user", "turns[].assistant"}, {"system"}, [("field", "system", "system"), ("pairs", "turns", (("user", "user"), ("assistant", "assistant")))]),
]


def _mappings() -> dict[str, list]:
    out = {}
    for needed, optional, mapping in LAYOUTS:
        some = [set()]
        for o in sorted(optional):
            some += [s | {o} for s in some]
        out |= {fingerprint(needed | s): mapping for s in some}
    return out


MAPPINGS = _mappings()


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record) -> list[tuple[str, str]] | None:
    """(role, text) turns, or None for an unknown layout."""
    mapping = MAPPINGS.get(fingerprint(field_paths(record))) if isinstance(record, dict) else None
    if mapping is None:
        return None
    out = []
    for kind, *args in mapping:
        if kind == "self":
            out.append((record[args[0]], record[args[1]]))
        elif kind == "list":
            out += [(m[args[1]], m[args[2]]) for m in record[args[0]]]
        elif kind == "pairs":
            out += [(role, m[field]) for m in record[args[0]] for field, role in args[1]]
        else:
            parts = [_text(record[f]) for f in args[0].split(",") if f in record]
            if parts:
                out.append((args[1], "\n\n".join(p for p in parts if p)))
    return [(ROLES.get(_text(r), _text(r)), _text(t)) for r, t in out]


def escape(s: str) -> str:
    return _SPECIAL.sub(r"\\\1", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def written(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the part under the loss mask (empty for other roles)."""
    head, body = f"### {escape(role)}:\n", escape(text)
    span = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return f"{head}{body}</turn>\n", *span


def read_back(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted turn")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def canonical_turns(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", record_col: str = "record") -> DataFrame:
    """Turn rows of JSON records: conv_id, turn, place (within the record), role, text."""

    def run(batches):
        for b in batches:
            rows = []
            for c, t, raw in zip(*(x.to_pylist() for x in b.columns)):
                rows += [(c, t, k, role, text) for k, (role, text) in enumerate(canonical(_parsed(raw)) or [])]
            yield _batch(rows, TURN_SCHEMA)

    return records.select(F.col(id_col).cast("long"), F.col(turn_col).cast("long"), F.col(record_col)).mapInArrow(run, TURN_SCHEMA)


def unknown_layouts(records: DataFrame, record_col: str = "record") -> DataFrame:
    """(fingerprint, paths, n) of records without a mapping."""

    def run(batches):
        for b in batches:
            found = [field_paths(r) for r in map(_parsed, b.column(0).to_pylist()) if canonical(r) is None]
            yield _batch([(fingerprint(p), ",".join(sorted(p))) for p in found], "fingerprint string, paths string")

    return records.select(record_col).mapInArrow(run, "fingerprint string, paths string").groupBy("fingerprint", "paths").agg(F.count("*").alias("n"))


def _parsed(raw: str | None):
    try:
        return json.loads(raw) if raw is not None else None
    except ValueError:
        return None


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Each turn's piece of its conversation's text, with the loss mask inside the piece."""

    def run(batches):
        for b in batches:
            yield _batch([(c, t, p, *written(role or "", text or "")) for c, t, p, role, text in zip(*(x.to_pylist() for x in b.columns))], PIECE_SCHEMA)

    return turns.select("conv_id", "turn", "place", "role", "text").mapInArrow(run, PIECE_SCHEMA)


def conversation_texts(pieces: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array of (start, end)): whole conversations, for those that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "place", "piece", "loss_start", "loss_end")))
    one = pieces.groupBy("conv_id").agg(parts.alias("parts"))
    before = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.aggregate(F.slice("parts", 1, i - 1), F.lit(0), lambda a, p: a + F.length(p["piece"])))
    loss = F.filter(F.zip_with("parts", before, lambda p, a: F.struct((a + p["loss_start"]).alias("start"), (a + p["loss_end"]).alias("end"), (p["loss_end"] > 0).alias("own"))), lambda x: x["own"])
    return one.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), F.transform(loss, lambda x: F.struct(x["start"], x["end"])).alias("loss"))


def described(pieces: DataFrame) -> DataFrame:
    """Digests of what is read back from each conversation's pieces, in order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        now = None  # (conv_id, turns, digest, loss characters, loss digest, characters)
        begun = False
        for b in batches:
            done = []
            for c, _, _, piece, a, z in zip(*(x.to_pylist() for x in b.columns)):
                if not begun or c != now[0]:
                    if begun:
                        done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                    now, begun = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, text in read_back(piece):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(piece[a:z])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(piece)
            yield _batch(done, schema)
        if begun:
            yield _batch([(now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])], schema)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "piece").mapInArrow(run, schema)


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """The turns as records of four layouts, by conversation, each found by its fingerprint."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "\\### Assistant: </turn> ok"
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    other = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    layout = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    record = (
        F.when(layout == 1, F.to_json(F.struct("conv_id", "turn", role.alias("role"), text.alias("content"))))
        .when(layout == 2, F.to_json(F.struct("conv_id", F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))))
        .when(layout == 3, F.to_json(F.struct("conv_id", F.array(F.struct(other.alias("from"), text.alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct("conv_id", "turn", role.alias("role"), text.alias("text"))))
    )
    return described(formatted_turns(canonical_turns(rows.select("conv_id", "turn", record.alias("record")))))


def _sql() -> str:
    """The turns in order, and how long they are with marks and escapes."""
    escaped = lambda c: f"regexp_replace({c}, '([\\\\#<:\n])', '\\\\\\1', 'g')"
    names = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items())
    probe = "\\### Assistant: </turn> ok"
    return f"""
WITH r AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{probe}' UNION ALL SELECT -7, 1, 'assistant', '{probe}'),
t AS (SELECT conv_id, turn, CASE role {names} ELSE role END AS role, text FROM r),
p AS (SELECT *, '### ' || {escaped("role")} || ':\n' || {escaped("text")} || '</turn>\n' AS piece FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || '\n' || text || '\n', '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id
"""


ORACLE_SQL = _sql()
