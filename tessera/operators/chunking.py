"""Chunkers: fixed token windows in SQL; structure-aware and planner-guided chunks, one document at a time.

A chunk is a row (chunk_id, strategy, doc_id, chunk_index, text, token_start, token_end, token_count, level, parent_id,
children_ids, title_path, fragments, metadata_json). Fragments say which characters of which block a chunk holds.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import pieces
from tessera.functions.text import LEAKS, SENTENCE_GAP, token_pieces
from tessera.functions.tokenizers import BytePairTokenizer, stable_windows
from tessera.session import scratch_folder
from tessera.sources.answered import AnswerStore, each

SEPARATOR = "\n\n"
#: Why a block of a type was split.
SPLIT_REASON = {
    "paragraph": "oversized_paragraph_sentence_split",
    "blockquote": "oversized_blockquote_sentence_split",
    "callout": "oversized_callout_sentence_split",
    "code_block": "oversized_code_line_split",
    "code_reference": "oversized_code_reference_line_split",
    "list": "oversized_list_item_split",
    "table": "oversized_table_row_split",
    "html_block": "oversized_html_line_split",
    "custom_block": "oversized_custom_line_split",
    "heading": "oversized_heading_line_split",
}
FALLBACK = "oversized_token_fallback"
FRAGMENT = "struct<block_index: int, block_type: string, char_start: int, char_end: int, fragment_index: int, fragment_count: int, fragment_sha256: string, split_reason: string, token_fallback: boolean>"
CHUNK = f"chunk_id string, strategy string, doc_id string, chunk_index int, text string, token_count int, level int, parent_id string, children_ids array<string>, title_path array<string>, fragments array<{FRAGMENT}>, metadata_json string"


# --- fixed windows ---------------------------------------------------------------------------------------------------


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of the windows over n tokens: the last one ends with the text, and none lies within the one before."""
    stride = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / stride).cast("int") * stride)
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, token_start, token_end, token_count, char_start, char_end, text) of (doc_id, text).

    Windows over the portable tokenizer's tokens. A chunk is the slice of the document from its first token to the start of
    the token behind it (the first chunk starts with the document, the last one ends with it), so that chunks without
    overlap are the document again. A document's windows are cut from its own token array: no shuffle. Documents without a
    token have no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    stride = size - overlap
    rows = docs.select("doc_id", "text", token_pieces(F.col("text")).alias("pieces")).withColumn("n", F.size("pieces"))
    rows = rows.withColumn("starts", window_starts(F.col("n"), size, overlap))
    # places are summed over strides, not over tokens
    lengths = F.transform("starts", lambda s: F.length(F.array_join(F.slice("pieces", s + 1, stride), "")))
    lead = F.length(F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0))
    places = F.aggregate(
        lengths,
        F.struct(lead.alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )
    rows = rows.select("doc_id", "text", "pieces", "n", F.posexplode(F.arrays_zip(F.col("starts").alias("s"), places.alias("p"))).alias("chunk_index", "w"))
    rows = rows.withColumn("token_start", F.col("w.s")).withColumn("token_end", F.least(F.col("w.s") + size, F.col("n")))
    own = F.array_join(F.slice("pieces", F.col("token_start") + 1, F.col("token_end") - F.col("token_start")), "")
    rows = rows.withColumn("char_end", F.col("w.p") + F.length(own)).withColumn("char_start", F.when(F.col("chunk_index") == 0, 0).otherwise(F.col("w.p")))
    return rows.select(
        F.format_string("%s::fixed::%06d", F.col("doc_id").cast("string"), "chunk_index").alias("chunk_id"),
        "doc_id",
        "chunk_index",
        "token_start",
        "token_end",
        (F.col("token_end") - F.col("token_start")).alias("token_count"),
        "char_start",
        "char_end",
        F.expr("substring(text, char_start + 1, char_end - char_start)").alias("text"),
    )


def byte_pair_chunks(docs: DataFrame, tokenizer: BytePairTokenizer, size: int = 512, overlap: int = 64) -> DataFrame:
    """fixed_chunks over byte-pair tokens, whose windows are moved to where their text is valid and encodes alike.

    adjusted says whether a window does not stand where plain arithmetic would put it.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    schema = "chunk_id string, doc_id string, chunk_index int, token_start int, token_end int, token_count int, char_start int, char_end int, text string, actual_overlap int, adjusted boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = tokenizer.encode(text or "")
                before, char, token = 0, 0, 0
                for i, (start, end) in enumerate(stable_windows(tokenizer, tokens, size, overlap) if tokens else []):
                    char += len(tokenizer.decode_strict(tokens[token:start]))
                    token, own = start, tokenizer.decode_strict(tokens[start:end])
                    adjusted = start != max(0, before - overlap) or end != min(start + size, len(tokens))
                    out.append((f"{doc_id}::fixed::{i:06d}", str(doc_id), i, start, end, end - start, char, char + len(own), own, before - start if i else 0, adjusted))
                    before = end
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), *[pa.int32()] * 6, pa.string(), pa.int32(), pa.bool_()), strict=True)], names)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, schema)


def fixed_errors(chunks: DataFrame, docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(chunk_id, problem): fixed chunks against those that the documents give: missing, unexpected, or of other content."""
    keep = ["chunk_id", "token_start", "token_end", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256")]
    want = fixed_chunks(docs, size, overlap).select(*keep, F.lit(True).alias("wanted"))
    have = chunks.select(*keep, F.lit(True).alias("there"))
    met = want.alias("w").join(have.alias("h"), "chunk_id", "full")
    same = [F.col(f"w.{c}") == F.col(f"h.{c}") for c in ("token_start", "token_end", "char_start", "char_end")]
    window, content = same[0] & same[1] & same[2] & same[3], F.col("w.text_sha256") == F.col("h.text_sha256")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(~window, "window").when(~content, "text")
    return met.select("chunk_id", problem.alias("problem")).where("problem is not null")


def window_gaps(chunks: DataFrame) -> DataFrame:
    """Chunks that start after everything before them has ended, or whose number does not follow the one before."""
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    seen = chunks.withColumn("reached", F.coalesce(F.max("token_end").over(before), F.lit(0))).withColumn("previous", F.coalesce(F.lag("chunk_index").over(order), F.lit(-1)))
    return seen.where((F.col("token_start") > F.col("reached")) | (F.col("chunk_index") != F.col("previous") + 1))


def chunk_statistics(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Distribution of token counts; quartiles interpolate linearly."""
    q = F.percentile("token_count", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.95)]))
    rows = chunks.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.sum("token_count").cast("long").alias("tokens"),
        F.min("token_count").alias("min_tokens"), F.avg("token_count").alias("mean_tokens"), F.max("token_count").alias("max_tokens"), q.alias("q"),
    )
    names = ("p25", "p50", "p75", "p95")
    return rows.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)]).drop("q")


def most_chunked(chunks: DataFrame, most: int = 10) -> DataFrame:
    rows = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("long").alias("tokens"))
    return rows.orderBy(F.col("chunks").desc(), F.col("tokens").desc(), "doc_id").limit(most)


# --- one document at a time ------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\w+|[^\w\s]")
_GAP = re.compile(SENTENCE_GAP)
_ITEM = re.compile(r"^[ \t]*(?:[-+*]|\d+[.)])[ \t]+", re.M)
_LEAKS = {name: re.compile(p) for name, p in LEAKS.items()}
#: What a text with such a leak holds in any case, casefolded (an i may be one without a dot): most texts hold none
#: of it, and are searched for nothing more.
_TELLTALES = {
    "private key": ("vate key",), "credential": ("key", "secret", "password"), "token": ("sk-", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "akia"), "Windows path": (":\\users\\",),
    "Unix path": ("/home/", "/users/"), "file URI": ("le://",), "environment key": ("openrouter_api_key", "openai_api_key"),
}


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


@dataclass(frozen=True)
class Fragment:
    block_index: int
    block_type: str
    char_start: int
    char_end: int
    fragment_index: int = 0
    fragment_count: int = 1
    split_reason: str | None = None
    token_fallback: bool = False


@dataclass
class Chunk:
    fragments: list[Fragment]
    text: str
    title_path: list[str] = field(default_factory=list)
    level: int = 0
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class StructureConfig:
    max_tokens: int = 512
    include_local_heading: bool = True


def pieces_at(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    """Spans between cuts, without empty ones; every character belongs to one."""
    edges = [0, *sorted({c for c in cuts if 0 < c < len(text)}), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def units(block: dict[str, Any]) -> list[tuple[int, int]]:
    """Where a block may be split: sentences of prose, items of a list, else lines. A unit keeps its trailing blanks."""
    text, kind = block["text"], block["type"]
    lines = [m.end() for m in re.finditer("\n", text)]
    if kind in ("paragraph", "blockquote", "callout"):
        return pieces_at(text, lines + [m.end() for m in _GAP.finditer(text)])
    if kind == "list":
        return pieces_at(text, [m.start() for m in _ITEM.finditer(text)])
    return pieces_at(text, lines)


def split_tokens(text: str, start: int, end: int, most: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """A span without a better place to split, cut every so many tokens; by halves where the tokenizer counts more."""
    ends = [m.end() + start for m in _TOKEN.finditer(text[start:end])]
    spans = pieces_at(text[start:end], [e - start for e in ends[most - 1 :: most]])
    out: list[tuple[int, int]] = []
    for a, b in ((start + a, start + b) for a, b in spans):
        if count(text[a:b]) > most and b - a > 1:
            middle = (a + b) // 2
            out += [p for x, y in ((a, middle), (middle, b)) for p in split_tokens(text, x, y, most, count)]
        else:
            out.append((a, b))
    return out


def split_block(block: dict[str, Any], index: int, most: int, count: Callable[[str], int] = count_tokens) -> list[Fragment]:
    """A block that fits stays whole; another is packed greedily from its units, and units too large are cut by tokens."""
    text, kind = block["text"], block["type"]
    if not text:
        return []
    if count(text) <= most:
        return [Fragment(index, kind, 0, len(text))]
    packed: list[tuple[int, int, bool]] = []
    for a, b in units(block):
        parts = [(a, b, False)]
        if count(text[a:b]) > most:
            lines = pieces_at(text[a:b], [m.end() for m in re.finditer("\n", text[a:b])]) if kind == "list" else [(0, b - a)]
            parts = []
            for x, y in lines:
                whole = count(text[a + x : a + y]) <= most
                parts += [(a + x, a + y, False)] if whole else [(p, q, True) for p, q in split_tokens(text, a + x, a + y, most, count)]
        for p, q, fallback in parts:
            if packed and not fallback and not packed[-1][2] and count(text[packed[-1][0] : q]) <= most:
                packed[-1] = (packed[-1][0], q, False)
            else:
                packed.append((p, q, fallback))
    return [Fragment(index, kind, a, b, i, len(packed), FALLBACK if f else SPLIT_REASON[kind], f) for i, (a, b, f) in enumerate(packed)]


def rendered(blocks: list[dict[str, Any]], fragments: list[Fragment]) -> str:
    """Texts of fragments; a blank line stands between different blocks only."""
    out = ""
    for i, f in enumerate(fragments):
        out += SEPARATOR if i and fragments[i - 1].block_index != f.block_index else ""
        out += blocks[f.block_index]["text"][f.char_start : f.char_end]
    return out


@dataclass
class Section:
    path: list[str]
    level: int
    blocks: list[int]


def sections(blocks: list[dict[str, Any]]) -> list[Section]:
    """A section per heading; a heading closes all open ones of its level or deeper. What precedes any has no path."""
    out = [Section([], 0, [])]
    open_: list[tuple[int, str]] = []
    for i, b in enumerate(blocks):
        if b["type"] == "heading":
            while open_ and open_[-1][0] >= b["level"]:
                open_.pop()
            open_.append((b["level"], b["text"]))
            out.append(Section([t for _, t in open_], b["level"], []))
        out[-1].blocks.append(i)
    return [s for s in out if s.blocks]


def positional_sections(blocks: list[dict[str, Any]]) -> list[tuple[int, list[str]]]:
    """(block, path) of every heading, where a heading of level n keeps the first n - 1 open titles: skipped levels nest
    siblings under each other, unlike in `sections`."""
    out: list[tuple[int, list[str]]] = []
    path: list[str] = []
    for i, b in enumerate(blocks):
        if b["type"] == "heading":
            path = [*path[: b["level"] - 1], b["text"]]
            out.append((i, path))
    return out


def structure_chunks_of(blocks: list[dict[str, Any]], config: StructureConfig, count: Callable[[str], int] = count_tokens) -> list[Chunk]:
    """Chunks never cross a section. A heading that does not fit beside the first content is kept as metadata only."""
    out: list[Chunk] = []
    for s in sections(blocks):
        fragments = [f for i in s.blocks for f in split_block(blocks[i], i, config.max_tokens, count)]
        omitted = None
        if config.include_local_heading and len(fragments) > 1 and fragments[0].block_type == "heading" and count(rendered(blocks, fragments[:2])) > config.max_tokens:
            omitted, fragments = fragments[0].block_index, fragments[1:]
        runs: list[list[Fragment]] = []
        for f in fragments:
            if runs and count(rendered(blocks, [*runs[-1], f])) <= config.max_tokens:
                runs[-1].append(f)
            else:
                runs.append([f])
        for k, run in enumerate(runs):
            following = runs[k + 1][0] if k + 1 < len(runs) else None
            reason = "section_end" if following is None else run[-1].split_reason or "block_budget" if following.block_index == run[-1].block_index else "block_budget"
            out.append(Chunk(run, rendered(blocks, run), s.path, s.level, {"boundary_reason": reason} | ({"omitted_heading_block": omitted} if omitted is not None and k == 0 else {})))
    return out


def section_links(chunks: list[Chunk]) -> list[tuple[int | None, list[int]]]:
    """(parent, children) of each chunk by number: a section's first chunk hangs below the last chunk of the section
    whose path is its own without the last title; sections of one title are roots."""
    first: dict[int, int] = {}
    runs: list[tuple[tuple[str, ...], int, int]] = []
    for i, c in enumerate(chunks):
        path = tuple(c.title_path)
        new = i == 0 or path != runs[-1][0] or chunks[i - 1].metadata.get("boundary_reason") == "section_end"
        if new:
            runs.append((path, i, i))
        else:
            runs[-1] = (path, runs[-1][1], i)
    latest: dict[tuple[str, ...], int] = {}
    for path, start, end in runs:
        if len(path) > 1 and path[:-1] in latest:
            first[start] = latest[path[:-1]]
        latest[path] = end
    children: dict[int, list[int]] = {}
    for child, parent in first.items():
        children.setdefault(parent, []).append(child)
    return [(first.get(i), children.get(i, [])) for i in range(len(chunks))]


# --- planner-guided --------------------------------------------------------------------------------------------------


class PlanError(ValueError):
    """A plan that is not a complete, ordered cover of its blocks."""


def parse_plan(raw: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Groups (first block, last block, reason) that cover start to end without gap or overlap."""

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in pairs}) != len(pairs):
            raise PlanError("a key stands twice")
        return dict(pairs)

    try:
        value = json.loads(raw, object_pairs_hook=unique)
    except PlanError:
        raise
    except ValueError as e:
        raise PlanError(f"not JSON: {e}") from e
    if not isinstance(value, dict) or value.keys() != {"groups"} or not isinstance(value["groups"], list) or not value["groups"]:
        raise PlanError("expected an object with a list of groups")
    out = []
    for g in value["groups"]:
        if not isinstance(g, dict) or g.keys() != {"start_block_index", "end_block_index", "reason"}:
            raise PlanError("a group has other fields")
        a, b, why = g["start_block_index"], g["end_block_index"], g["reason"]
        if type(a) is not int or type(b) is not int or not isinstance(why, str):
            raise PlanError("a field has another type")
        if a != (out[-1][1] + 1 if out else start) or not a <= b <= end:
            raise PlanError(f"group {a}-{b} does not follow")
        out.append((a, b, why))
    if out[-1][1] != end:
        raise PlanError(f"the plan ends at {out[-1][1]}, not {end}")
    return out


@dataclass(frozen=True)
class PlannerConfig:
    max_tokens: int = 512
    batch_tokens: int = 12_000
    preview_tokens: int = 120
    #: How often a plan that is no plan is asked for again, with what was wrong.
    corrections: int = 1


def preview(text: str, most: int) -> str:
    """The whole text if it is short, else its head and tail of a third of the budget each."""
    if len(text) <= most:  # no text has more tokens than characters
        return text
    ends = [m.end() for m in _TOKEN.finditer(text)]
    if len(ends) <= most:
        return text
    part = max(1, most // 3)
    tail = [m.start() for m in _TOKEN.finditer(text)][-part]
    return f"{text[: ends[part - 1]]} … {text[tail:]}"


def structure_summary(block: dict[str, Any]) -> dict[str, Any]:
    """What a planner is told of a block's build: size of a table, items and depth of a list, kind of a callout, state of a
    code reference, language of code, level of a heading."""
    more = json.loads(block.get("metadata_json") or "{}")
    kind = block["type"]
    if kind == "table":
        return {"rows": len(more.get("rows", [])), "columns": len(more.get("header", []))}
    if kind == "list":
        items = more.get("items", [])
        return {"items": len(items), "max_level": max((x["level"] for x in items), default=0), "ordered": bool(block.get("ordered"))}
    if kind == "callout":
        return {"kind": more.get("kind")}
    if kind == "code_reference":
        return {"path": more.get("attributes", {}).get("path"), "resolved": False}
    if kind == "code_block":
        return {"language": block.get("language")}
    return {"level": block["level"]} if kind == "heading" else {}


def candidates(blocks: list[dict[str, Any]], config: PlannerConfig) -> list[dict[str, Any]]:
    """What the planner sees of each block."""
    paths = {i: s.path for s in sections(blocks) for i in s.blocks}
    return [
        {"block_index": i, "type": b["type"], "heading_path": paths[i], "structure": structure_summary(b), "token_count": count_tokens(b["text"]), "sha256": hashlib.sha256(b["text"].encode()).hexdigest(), "preview": preview(b["text"], config.preview_tokens)}
        for i, b in enumerate(blocks)
    ]


def batched(items: list[Any], cost: Callable[[Any], int], most: int, most_items: int | None = None) -> list[list[Any]]:
    """Greedy batches in order within a budget; an item over the budget is refused."""
    out: list[list[Any]] = []
    used = 0
    for x in items:
        c = cost(x)
        if c > most:
            raise ValueError(f"an item of {c} exceeds the budget of {most}")
        if out and used + c <= most and (most_items is None or len(out[-1]) < most_items):
            out[-1].append(x)
            used += c
        else:
            out.append([x])
            used = c
    return out


def by_sections(request: list[dict[str, Any]]) -> str:
    """The offline planner: a group for each run of blocks with one heading path."""
    groups: list[dict[str, Any]] = []
    for c in request:
        if groups and groups[-1]["path"] == c["heading_path"]:
            groups[-1]["end"] = c["block_index"]
        else:
            groups.append({"path": c["heading_path"], "start": c["block_index"], "end": c["block_index"]})
    return json.dumps({"groups": [{"start_block_index": g["start"], "end_block_index": g["end"], "reason": "section"} for g in groups]})


#: The form of a plan, for providers that take a JSON schema.
PLAN_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["groups"],
    "properties": {
        "groups": {
            "type": "array",
            "minItems": 1,
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["start_block_index", "end_block_index", "reason"],
                "properties": {"start_block_index": {"type": "integer", "minimum": 0}, "end_block_index": {"type": "integer", "minimum": 0}, "reason": {"type": "string"}},
            },
        }
    },
}

Planner = Callable[[list[dict[str, Any]]], str]


def requests_of(blocks: list[dict[str, Any]], config: PlannerConfig) -> list[list[dict[str, Any]]]:
    """The batches of candidates a document asks a plan for; a candidate over the batch budget is refused."""
    each = [(c, json.dumps(c, ensure_ascii=False)) for c in candidates(blocks, config)]
    if sum(len(text) for _, text in each) <= config.batch_tokens:  # no text has more tokens than characters: they fit one batch
        return [[c for c, _ in each]] if each else []
    return [[c for c, _ in batch] for batch in batched(each, lambda x: count_tokens(x[1]), config.batch_tokens)]


def request_json(request: list[dict[str, Any]]) -> str:
    return json.dumps(request, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def request_digest(request: list[dict[str, Any]]) -> str:
    return hashlib.sha256(request_json(request).encode()).hexdigest()


class UnsafeRequestError(ValueError):
    """A request that would carry a secret or a private path out."""


def check_outbound(payload: str, secrets: tuple[str, ...] = ()) -> None:
    """Raise if a payload holds a configured secret or looks as if it held one; nothing is redacted."""
    plain = payload.casefold()
    found = [name for name, p in _LEAKS.items() if any(x in plain for x in _TELLTALES.get(name, ("",))) and p.search(payload)]
    if found or any(s and s in payload for s in secrets):
        raise UnsafeRequestError(", ".join(found) or "configured secret")


def resolve_plan(request: list[dict[str, Any]], plan: Planner, config: PlannerConfig = PlannerConfig(), secrets: tuple[str, ...] = ()) -> str:
    """A valid plan's text: asked for, and asked for again with the error, as often as the config allows."""
    check_outbound(request_json(request), secrets)
    start, end = request[0]["block_index"], request[-1]["block_index"]
    asked = request
    for attempt in range(config.corrections + 1):
        raw = plan(asked)
        try:
            parse_plan(raw, start, end)
            return raw
        except PlanError as e:
            if attempt == config.corrections:
                raise
            asked = [*request, {"correction": str(e), "heading_path": None, "block_index": end}]
    raise AssertionError


def pack_group(blocks: list[dict[str, Any]], first: int, last: int, most: int, count: Callable[[str], int] = count_tokens) -> list[list[Fragment]]:
    """Fragments of a group's blocks, packed greedily. The separator that leads to a block is counted where it will stand,
    also before the first block of a chunk; a block without text is a fragment of no length."""
    runs: list[list[Fragment]] = []
    for i in range(first, last + 1):
        for f in split_block(blocks[i], i, most, count) or [Fragment(i, blocks[i]["type"], 0, 0)]:
            lead = lambda run: SEPARATOR if run[0].block_index > 0 and run[0].char_start == 0 else ""
            if runs and count(lead(runs[-1]) + rendered(blocks, [*runs[-1], f])) <= most:
                runs[-1].append(f)
            else:
                runs.append([f])
    return runs


def assemble(blocks: list[dict[str, Any]], plans: list[list[tuple[int, int, str]]], config: PlannerConfig) -> list[Chunk]:
    """Chunks that together are exactly the document's linear text: a separator belongs to the block it leads to."""
    out: list[Chunk] = []
    paths = {i: s.path for s in sections(blocks) for i in s.blocks}
    for a, b, why in (g for groups in plans for g in groups):
        runs = pack_group(blocks, a, b, config.max_tokens)
        for k, run in enumerate(runs):
            lead = SEPARATOR if run[0].block_index > 0 and run[0].char_start == 0 else ""
            crossed = len({tuple(paths[f.block_index]) for f in run}) > 1
            out.append(Chunk(run, lead + rendered(blocks, run), paths[run[0].block_index], len(paths[run[0].block_index]), {"planner_reason": why, "group_part": k, "group_adjusted": len(runs) > 1, "crosses_sections": crossed}))
    return out


def planned_chunks_of(blocks: list[dict[str, Any]], config: PlannerConfig, plan: Planner = by_sections) -> list[Chunk]:
    """One document, planned where it stands."""
    plans = [parse_plan(resolve_plan(r, plan, config), r[0]["block_index"], r[-1]["block_index"]) for r in requests_of(blocks, config)]
    return assemble(blocks, plans, config)


def planned_chunks(
    docs: DataFrame, plan: Planner = by_sections, config: PlannerConfig = PlannerConfig(), cache: DataFrame | None = None, secrets: tuple[str, ...] = (), store: AnswerStore | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, failures, plans) of parsed documents (doc_id, blocks): equal requests are asked once, over all documents.

    Requests are asked when this is called, and kept in the store, which all three results read: however often they are
    read, nothing is asked again. Without a store, a new one below the shared folder serves. cache: (digest, request, plan)
    of other runs; whole requests are kept and compared, a plan under another request's digest is an error. A document with
    a request that failed is left out whole; failures are (doc_id, problem). plans are (digest, request, plan) of these
    documents. The documents are written below the shared folder once, so that no result parses them anew.
    """
    spark = docs.sparkSession
    store = store or AnswerStore(spark, f"{scratch_folder(spark)}/plans", {"planner": asdict(config)})
    held = f"{scratch_folder(spark)}/documents"
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), "blocks").write.parquet(held)
    ask = spark.read.parquet(held)

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[tuple] = []
            for doc_id, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts = [request_json(r) for r in requests_of(blocks or [], config)]
                    rows += [(doc_id, i, hashlib.sha256(text.encode()).hexdigest(), text, None) for i, text in enumerate(texts)]
                except ValueError as e:
                    rows.append((doc_id, 0, None, None, str(e)))
            kinds = pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "part", "key", "request", "problem"])

    path = f"{store.path}/requests-{uuid.uuid4().hex}"
    ask.mapInArrow(request, "doc_id string, part int, key string, request string, problem string").write.parquet(path)
    asked = spark.read.parquet(path)
    wanted = asked.where("key is not null").select("key", "request")
    if cache is not None:
        store.seed(cache.select(F.col("digest").alias("key"), "request", F.col("plan").alias("answer")), wanted)
    store.fill(wanted, each(lambda raw: resolve_plan(json.loads(raw), plan, config, secrets)))
    given = store.answers().select("key", F.col("answer").alias("plan")).unionByName(store.failures().select("key", F.col("problem").alias("failed")), allowMissingColumns=True)
    met = asked.drop("request").join(given, "key", "left").withColumn("problem", F.coalesce("problem", "failed"))
    by_doc = met.groupBy("doc_id").agg(F.min("problem").alias("problem"), F.transform(F.array_sort(F.collect_list(F.struct("part", "plan"))), lambda p: p["plan"]).alias("plans"))
    failures = by_doc.where("problem is not null").select("doc_id", "problem")
    ready = ask.join(by_doc.where("problem is null").select("doc_id", "plans"), "doc_id").select("doc_id", "blocks", "plans")
    chunks = chunk_rows(ready, "prompt", lambda blocks, plans: assemble(blocks, [parse_cover(p) for p in plans], config))
    return chunks, failures, store.answers().join(wanted.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("digest"), "request", F.col("answer").alias("plan"))


def parse_cover(raw: str) -> list[tuple[int, int, str]]:
    """The groups of a plan that was found valid."""
    return [(g["start_block_index"], g["end_block_index"], g["reason"]) for g in json.loads(raw)["groups"]]


# --- as DataFrames ---------------------------------------------------------------------------------------------------

STRATEGIES: dict[str, Callable[[list[dict[str, Any]]], list[Chunk]]] = {
    "structure": lambda blocks: structure_chunks_of(blocks, StructureConfig()),
    "prompt": lambda blocks: planned_chunks_of(blocks, PlannerConfig()),
}


class UnavailableStrategyError(ValueError):
    """A strategy nobody registered."""


def chunk_documents(docs: DataFrame, strategy: str, make: Callable[[list[dict[str, Any]]], list[Chunk]] | None = None) -> DataFrame:
    """Chunks of parsed documents (doc_id, blocks). A document is chunked where it stands: no shuffle."""
    if make is None and strategy not in STRATEGIES:
        raise UnavailableStrategyError(strategy)
    return chunk_rows(docs.select("doc_id", "blocks"), strategy, make or STRATEGIES[strategy])


def chunk_rows(docs: DataFrame, strategy: str, make: Callable[..., list[Chunk]]) -> DataFrame:
    """make's chunks of the columns behind doc_id, the first of which are the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows: list[dict[str, Any]] = []
            for doc_id, blocks, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunks = make(blocks or [], *more)
                name = lambda i, d=doc_id: f"{d}::{strategy}::{i:06d}"
                for i, (c, (parent, children)) in enumerate(zip(chunks, section_links(chunks), strict=True)):
                    fragments = [vars(f) | {"fragment_sha256": hashlib.sha256(blocks[f.block_index]["text"][f.char_start : f.char_end].encode()).hexdigest()} for f in c.fragments]
                    rows.append({"chunk_id": name(i), "strategy": strategy, "doc_id": str(doc_id), "chunk_index": i, "text": c.text, "token_count": count_tokens(c.text), "level": c.level, "parent_id": None if parent is None else name(parent), "children_ids": [name(k) for k in children], "title_path": c.title_path, "fragments": fragments, "metadata_json": json.dumps(c.metadata, sort_keys=True)})
            if rows:
                fragment = pa.struct([("block_index", pa.int32()), ("block_type", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("fragment_index", pa.int32()), ("fragment_count", pa.int32()), ("fragment_sha256", pa.string()), ("split_reason", pa.string()), ("token_fallback", pa.bool_())])
                kinds = pa.schema([("chunk_id", pa.string()), ("strategy", pa.string()), ("doc_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("token_count", pa.int32()), ("level", pa.int32()), ("parent_id", pa.string()), ("children_ids", pa.list_(pa.string())), ("title_path", pa.list_(pa.string())), ("fragments", pa.list_(fragment)), ("metadata_json", pa.string())])
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return docs.mapInArrow(run, CHUNK)


def contract_errors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, problem): numbering gaps, links that are not mutual, duplicate ids. What is looked at of the chunks is
    written below the shared folder once: the checks read it several times."""
    spark = chunks.sparkSession
    held = f"{scratch_folder(spark)}/chunks"
    chunks.select("chunk_id", "strategy", "doc_id", "chunk_index", "parent_id", "children_ids").write.parquet(held)
    chunks = spark.read.parquet(held)
    order = Window.partitionBy("strategy", "doc_id").orderBy("chunk_index")
    gaps = chunks.withColumn("previous", F.coalesce(F.lag("chunk_index").over(order), F.lit(-1))).where(F.col("chunk_index") != F.col("previous") + 1).select("chunk_id", F.lit("numbering").alias("problem"))
    down = chunks.select(F.col("chunk_id").alias("parent"), F.explode("children_ids").alias("child"))
    up = chunks.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("parent"), F.col("chunk_id").alias("child"))
    one_way = up.join(down, ["parent", "child"], "left_anti").union(down.join(up, ["parent", "child"], "left_anti")).select(F.col("child").alias("chunk_id"), F.lit("link").alias("problem"))
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("duplicate id").alias("problem"))
    return gaps.union(one_way).union(twice)


def fragment_errors(chunks: DataFrame, block_rows: DataFrame) -> DataFrame:
    """(chunk_id, problem): fragments whose hash is not that of the block's slice, or that leave a gap in their block."""
    f = chunks.select("chunk_id", "doc_id", "chunk_index", F.posexplode("fragments").alias("pos", "f")).select("chunk_id", "doc_id", "chunk_index", "pos", "f.*")
    blocks = block_rows.select(F.col("doc_id").cast("string").alias("doc_id"), "block_index", F.col("text").alias("block_text"))
    met = f.join(blocks, ["doc_id", "block_index"])
    wrong = F.sha2(F.expr("substring(block_text, char_start + 1, char_end - char_start)"), 256) != F.col("fragment_sha256")
    order = Window.partitionBy("doc_id", "block_index").orderBy("chunk_index", "pos")
    gap = F.col("char_start") != F.coalesce(F.lag("char_end").over(order), F.lit(0))
    checked = met.select("chunk_id", F.array(F.when(wrong, "hash"), F.when(gap, "coverage")).alias("problems"))
    return checked.select("chunk_id", F.explode(F.array_compact("problems")).alias("problem"))  # one pass for both


def partition_errors(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose planned chunks, one after the other, are not their linear text, those without chunks included. docs:
    (doc_id, text)."""
    joined = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "").alias("whole"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(joined, "doc_id", "left").where(F.coalesce("whole", F.lit("")) != F.col("text")).select("doc_id")


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """min, mean, median and max in one row; zeros where there is no row."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return rows.agg(zero(F.min(column)).alias("min"), zero(F.avg(column)).alias("mean"), zero(F.percentile(column, F.lit(0.5))).alias("median"), zero(F.max(column)).alias("max"))


def coverage_gaps(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, covered, length): documents of which fixed chunks leave characters out. docs: (doc_id, text)."""
    before = Window.partitionBy("doc_id").orderBy("char_start", "char_end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = chunks.withColumn("reached", F.coalesce(F.max("char_end").over(before), F.lit(0)))
    covered = fresh.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("char_end") - F.greatest("char_start", "reached"))).alias("covered"))
    met = docs.select("doc_id", F.length("text").cast("long").alias("length")).join(covered, "doc_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return met.where(F.col("covered") < F.col("length")).select("doc_id", "covered", "length")


def block_type_statistics(chunks: DataFrame) -> DataFrame:
    """(block_type, chunks, fragments, split_fragments): chunks that hold a type, its fragments, and those of split blocks."""
    f = chunks.select("chunk_id", F.explode("fragments").alias("f")).select("chunk_id", "f.*")
    return f.groupBy("block_type").agg(F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("fragments"), F.sum(F.when(F.col("fragment_count") > 1, 1).otherwise(0)).alias("split_fragments"))


def structure_statistics(chunks: DataFrame) -> DataFrame:
    """(reason, chunks) of structure-aware chunks: why they end."""
    return chunks.groupBy(F.get_json_object("metadata_json", "$.boundary_reason").alias("reason")).agg(F.count("*").alias("chunks"))


def planned_statistics(chunks: DataFrame) -> DataFrame:
    """Rates of adjusted groups and of chunks across sections."""
    rate = lambda name: F.avg(F.when(F.get_json_object("metadata_json", f"$.{name}") == "true", 1.0).otherwise(0.0)).alias(f"{name}_rate")
    return chunks.agg(F.count("*").alias("chunks"), rate("group_adjusted"), rate("crosses_sections"))
