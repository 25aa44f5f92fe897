"""Places for models: embedding, query rewriting, scoring, describing, fetching.

Each is a function of columns with a deterministic default, and a caller may pass its own.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.scalar import strip_placeholders


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cjk_tokens(text: Column) -> Column:
    """As tokens, with runs of Han characters as single characters and pairs."""
    han = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{IsHan}+"), F.lit(0))
    grams = F.flatten(F.transform(han, lambda x: F.concat(F.split(x, ""), F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))))
    other = tokens(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{IsHan}+", " "))
    return F.concat(F.filter(grams, lambda x: x != ""), other)


def hashing_embedding(size: int = 64):
    """Embeds text as signed counts of hashed tokens, of unit length; a text without tokens is a zero vector."""

    @F.arrow_udf("array<float>")
    def embed(words: pa.Array) -> pa.Array:
        return hashed_vectors(words, size)

    return lambda text: embed(tokens(strip_placeholders(text)))


def hashed_vectors(words: pa.Array, size: int) -> pa.Array:
    """A vector for each list of words; each distinct word is hashed once."""
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    said = words.flatten().dictionary_encode()
    hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in said.dictionary.to_pylist()], np.uint64)[said.indices.to_numpy(zero_copy_only=False)]
    place = np.repeat(np.arange(len(n)), n) * size + (hashes % np.uint64(size)).astype(np.int64)
    v = np.bincount(place, np.where(hashes >> np.uint64(63), 1.0, -1.0), len(n) * size).astype(np.float64).reshape(-1, size)  # without any word it counts in whole numbers
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    v = np.divide(v, length, out=v, where=length > 0).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array(v.ravel()))


def unescape(text: Column) -> Column:
    """HTML entities decoded, all named and numeric ones."""

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([html.unescape(t) if t and "&" in t else t for t in text.to_pylist()], pa.string())

    return run(text)


def describe(kind: str, data: Column) -> Column:
    """A text for the bytes of an image or a video; none without a model."""
    if kind not in ("image", "video"):
        raise ValueError(f"nothing describes a {kind}")
    return F.lit(None).cast("string")


def asked_json(model, prompt: Column, required: tuple[str, ...] = (), attempts: int = 4) -> Column:
    """struct<json, attempts, error> of a model's answer to a prompt: asked again, up to so many times in all, while the
    answer holds no JSON object or lacks a required key. model(prompts, attempt) gives an answer for each prompt,
    or None where it failed, which is an error at once and not asked again."""

    @F.arrow_udf("struct<json: string, attempts: int, error: string>")
    def run(prompt: pa.Array) -> pa.Array:
        prompts = prompt.to_pylist()
        out: list[dict] = [{"json": None, "attempts": 0, "error": "no prompt"} for _ in prompts]
        left = [i for i, p in enumerate(prompts) if p is not None]
        for attempt in range(1, attempts + 1):
            if not left:
                break
            again = []
            for i, answer in zip(left, model([prompts[i] for i in left], attempt), strict=True):
                found, error = (None, "no answer") if answer is None else _object_in(answer, required)
                out[i] = {"json": found, "attempts": attempt, "error": error}
                if error and answer is not None:
                    again.append(i)
            left = again
        return pa.array(out, pa.struct([("json", pa.string()), ("attempts", pa.int32()), ("error", pa.string())]))

    return run(prompt)


def _object_in(answer: str, required: tuple[str, ...]) -> tuple[str | None, str | None]:
    """(the JSON object of an answer, None) or (None, what is wrong)."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    braces = re.search(r"\{.*\}", answer, re.S)
    text = fenced[1].strip() if fenced else braces[0] if braces else answer.strip()
    try:
        value = json.loads(text)
    except ValueError as e:
        return None, f"no JSON: {e}"
    if not isinstance(value, dict):
        return None, "not an object"
    lacking = [k for k in required if k not in value]
    return (None, f"lacks {', '.join(lacking)}") if lacking else (text, None)


def rewrite_query(query: Column) -> Column:
    """struct<rewritten_query, keywords, intent>: the query trimmed, its distinct tokens, no intent."""
    return F.struct(F.btrim(query).alias("rewritten_query"), F.array_distinct(tokens(query)).alias("keywords"), F.lit(None).cast("string").alias("intent"))


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct tokens that the content holds."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(content))) / F.size(q))


def clamp(score: Column) -> Column:
    return F.when(score.isNotNull() & ~F.isnan(score), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
