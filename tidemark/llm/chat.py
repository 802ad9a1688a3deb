"""Chat formatting: schema fingerprints select declarative mappings into canonical turns; turns are rendered by a template
whose control strings are escaped reversibly, and read back from the rendered text.

Everything but the running digests is DataFrame expressions: a record's fingerprint is a hash over the nested field paths
that are present in it, and a mapping says which path feeds which part of a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import tidy


@dataclass(frozen=True)
class Turns:
    """One source of turns inside a record. ``path`` is an array (``messages[]``) whose elements are turns, or None when the
    record's own fields are one turn. ``role`` and ``text`` are paths relative to it; ``fixed_role`` replaces ``role``."""

    text: str
    role: str | None = None
    fixed_role: str | None = None
    path: str | None = None


@dataclass(frozen=True)
class Mapping:
    """A layout: paths that must be present, paths that may be, where key and position come from, and its turns in order."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Turns, ...]
    seq: str | None = None
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> set[str]:
        return {*self.required, *self.optional}

    def fingerprints(self) -> list[str]:
        """Those of each set of paths that this mapping accepts."""
        return [fingerprint_of((*self.required, *some)) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


#: Public layouts: flat turn rows, message lists with role and content, lists with from and value, prompt and response,
#: instruction with input and output.
FLAT = Mapping("flat", (), ("turn", "role", "text"), (Turns(text="text", role="role"),), seq="turn")
MESSAGES = Mapping("messages", ("messages[].content",), ("messages[].role",), (Turns(text="content", role="role", path="messages"),))
SHARE = Mapping("share", ("conversations[].value",), ("conversations[].from",), (Turns(text="value", role="from", path="conversations"),), roles=(("human", "user"), ("gpt", "assistant")))
PROMPT = Mapping("prompt", ("prompt",), ("response", "system"), (Turns(text="system", fixed_role="system"), Turns(text="prompt", fixed_role="user"), Turns(text="response", fixed_role="assistant")))
INSTRUCTION = Mapping(
    "instruction", ("instruction",), ("input", "output"), (Turns(text="instruction", fixed_role="user"), Turns(text="input", fixed_role="user"), Turns(text="output", fixed_role="assistant"))
)
MAPPINGS = (FLAT, MESSAGES, SHARE, PROMPT, INSTRUCTION)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.StructType, prefix: str = "") -> dict[str, tuple[str, ...]]:
    """Leaf paths of a schema with arrays of records marked by ``[]``: path to its steps."""
    out: dict[str, tuple[str, ...]] = {}
    for f in schema.fields:
        here = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out |= {k: (f.name, *v) for k, v in schema_paths(f.dataType, here + ".").items()}
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out |= {k: (f.name + "[]", *v) for k, v in schema_paths(f.dataType.elementType, here + "[].").items()}
        else:
            out[here] = (f.name,)
    return out


def _present(at: Column, steps: tuple[str, ...]) -> Column:
    head, rest = steps[0], steps[1:]
    if head.endswith("[]"):
        return F.exists(at[head[:-2]], lambda x: _present(x, rest))
    return _present(at[head], rest) if rest else at[head].isNotNull()


def fingerprint(record: Column, schema: T.StructType, mappings=MAPPINGS) -> Column:
    """Hash of the mapped nested paths that hold a value in the record. Fields that no mapping names don't take part."""
    known = set().union(*(m.paths for m in mappings))
    paths = {k: v for k, v in sorted(schema_paths(schema).items()) if k in known}
    there = F.array_compact(F.array(*[F.when(F.coalesce(_present(record, steps), F.lit(False)), F.lit(path)) for path, steps in paths.items()])) if paths else F.array().cast("array<string>")
    return F.sha2(F.array_join(F.array_sort(there), "\n").cast("binary"), 256)


def canonical_turns(records: DataFrame, key_col: str, mappings=MAPPINGS) -> DataFrame:
    """``key, layout, seq, part, role, text``: one row per turn of each record.

    ``records`` may mix layouts: each record's own fingerprint picks its mapping. ``seq`` is the record's position field
    where the layout has one (else null) and ``part`` the turn's place in the record. Null texts and roles are empty. A
    record that fits no mapping gives one row with a null layout, so nothing is lost unseen. Columns beyond those of the
    mappings are ignored. Repeated records repeat their turns; an empty table gives no rows.
    """
    schema = records.schema
    steps = schema_paths(schema)
    record = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    rows = records.select(F.col(f"`{key_col}`").alias("key"), record.alias("r")).withColumn("fp", fingerprint(F.col("r"), schema, mappings))
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    layout, turns, seq = F.lit(None).cast("string"), F.lit(None).cast(kind), F.lit(None).cast("long")

    def get(at: Column, name: str | None, there: bool) -> Column:
        return F.coalesce(at[name].cast("string"), F.lit("")) if name and there else F.lit("")

    def named(m: Mapping, role: Column) -> Column:
        out = role
        for a, b in m.roles:
            out = F.when(role == a, b).otherwise(out)
        return out

    for m in mappings:
        if not any(p in steps for p in m.paths) or not all(p in steps for p in m.required):
            continue
        parts = []
        for t in m.turns:
            if t.path:
                inside = {p.split("[].", 1)[1] for p in steps if p.startswith(f"{t.path}[].")}

                def turn(x: Column) -> Column:
                    return F.struct(named(m, get(x, t.role, t.role in inside)).alias("role"), get(x, t.text, t.text in inside).alias("text"))  # noqa: B023

                parts.append(F.transform(F.col("r")[t.path], turn))
            else:
                one = F.array(F.struct((F.lit(t.fixed_role) if t.fixed_role else named(m, get(F.col("r"), t.role, t.role in steps))).alias("role"), get(F.col("r"), t.text, t.text in steps).alias("text")))
                # A field of a multi-field layout that is absent is no turn; a flat row is always one.
                parts.append(one if m.seq else F.when(F.col("r")[t.text].isNotNull(), one).otherwise(F.array().cast(kind)) if t.text in steps else F.array().cast(kind))
        hit = F.col("fp").isin(m.fingerprints())
        layout, turns = F.when(hit, m.name).otherwise(layout), F.when(hit, F.concat(*parts) if len(parts) > 1 else parts[0]).otherwise(turns)
        if m.seq and m.seq in steps:
            seq = F.when(hit, F.col("r")[m.seq].cast("long")).otherwise(seq)
    return rows.select("key", layout.alias("layout"), seq.alias("seq"), F.posexplode_outer(turns).alias("part", "t")).select("key", "layout", "seq", "part", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


#: Template: a turn is OPEN role SEP text CLOSE. The escape character comes before every character that a control string begins with.
OPEN, SEP, CLOSE, ESCAPE = "### ", ": ", " </turn>\n", "\\"
_ESCAPED = r"([\\#<:])"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPED, r"\\$1")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def render(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` (the turn under the template) and the loss mask: code points ``loss_from`` (from 0) and ``loss_len``
    of ``formatted`` that are trained on, the escaped text of turns of ``loss_roles``. A conversation is the concatenation
    of its turns' ``formatted``, which are kept apart so that no conversation has to fit into one value."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    return turns.select("*", F.concat(head, body, F.lit(CLOSE)).alias("formatted"), F.length(head).alias("loss_from"), F.when(F.col("role").isin(*loss_roles), F.length(body)).otherwise(0).alias("loss_len"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds what the rendered text alone says: ``role_back``, ``text_back`` and ``loss_back``, the unescaped masked text."""
    pattern = r"(?s)^### ((?:\\.|[^\\:])*): (.*) </turn>\n$"
    return rendered.select(
        "*", unescape(F.regexp_extract("formatted", pattern, 1)).alias("role_back"), unescape(F.regexp_extract("formatted", pattern, 2)).alias("text_back"),
        unescape(F.substring(F.col("formatted"), F.col("loss_from") + 1, F.col("loss_len"))).alias("loss_back"),
    )


def digest_conversations(turns: DataFrame, order: tuple[str, ...] = ("seq", "part", "role_back", "text_back")) -> DataFrame:
    """Per key: turns, digests of all turns and of the loss text, and code points. Rows stream in order through running
    digests, so a conversation of any number of turns takes constant memory."""
    schema = "key {t}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long".format(t=turns.schema["key"].dataType.simpleString())
    rows = turns.filter("layout is not null").select("key", *order, *[c for c in ("loss_back",) if c not in order], F.length("formatted").cast("long").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done, kind = None, None, [], None

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], kind)] + [pa.array([d[k] for d in done], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.string()), (5, pa.int64()))],
                ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            done.clear()
            return out

        for b in batches:
            kind = b.schema.field("key").type
            for k, role, text, loss, chars in zip(*(b.column(c).to_pylist() for c in ("key", "role_back", "text_back", "loss_back", "chars"))):
                if state is None or k != key:
                    if state:
                        done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if len(done) >= 5000:
                yield flush()
        if state:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            yield flush()

    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(tidy(run), schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered turns of a table of flat turn rows ``conv_id, turn, role, text``, read back."""
    return read_back(render(canonical_turns(conversations.select("conv_id", "turn", "role", "text"), "conv_id")))
