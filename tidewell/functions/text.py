"""Text functions: word chunks, normalisation, names, truncation, JSON in prose."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import once

CHUNK_SIZE, CHUNK_OVERLAP = 128, 32


def words(text: Column | str) -> Column:
    """White-space separated words; none for null or blank text."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+"), lambda w: w != "")


def chunks(text: Column | str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of ``size`` words, the last ending at the last word; repeated chunks once."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the chunk size")
    stride = size - overlap

    def windows(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(ws) - size) / F.lit(stride)).cast("int")))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(ws, i * stride + 1, F.lit(size)), " "))
        return F.when(F.size(ws) > 0, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))

    return once(words(text), windows)  # a text is split once, not for every chunk


def explode_chunks(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``id_col, pos, chunk``: a row for each chunk; documents without words have none."""
    return docs.select(F.col(id_col), F.posexplode(chunks(text, size, overlap)).alias("pos", "chunk"))


def text_hash(text: Column | str) -> Column:
    """SHA-1 of the text with white space normalised."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha1(F.trim(F.regexp_replace(c, r"\s+", " ")))


def safe_filename(name: Column | str, most: int = 100) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}\-._]", "_"), 1, most)


def file_name(name: str, most: int = 100) -> str:
    """``safe_filename`` of a name that the driver has."""
    return "".join(c if c.isalnum() or c in "-._" else "_" for c in name)[:most]


def strip_reasoning(text: Column | str, marker: str) -> Column:
    """What follows the first occurrence of ``marker``, in any case; the whole text if there is none."""
    c = F.col(text) if isinstance(text, str) else text
    at = F.locate(marker.lower(), F.lower(c))
    return F.trim(F.when(at > 0, F.substring(c, at + len(marker), F.length(c))).otherwise(c))


def shortened(text: Column | str, most: int = 50) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def ask_for_json(prompt: Column | str) -> Column:
    c = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.when(~F.lower(c).contains("json"), F.concat(c, F.lit("\n\nAnswer with one JSON object."))).otherwise(c)


def embedded_json(reply: Column | str) -> Column:
    """The JSON object of a reply: the reply itself, a fenced block, or from the first to the last brace; null if none parses."""
    c = F.col(reply) if isinstance(reply, str) else reply
    tries = [F.trim(c), F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1)]
    return F.coalesce(*[F.when(F.json_object_keys(t).isNotNull(), t) for t in tries])


def last_json_object(reply: str | None) -> str | None:
    """The last balanced object in a reply that parses; braces inside strings don't count."""
    decoder, found, at = json.JSONDecoder(), None, 0
    text = reply or ""
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        found, at = json.dumps(value, sort_keys=True), end
    return found


def final_json(reply: Column | str) -> Column:
    """The JSON object of a reply that may think aloud first: what ``embedded_json`` finds, else the last balanced object; keys sorted."""

    def run(whole: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([last_json_object(f if isinstance(f, str) else w) for w, f in zip(whole, found, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(F.col(reply) if isinstance(reply, str) else reply, embedded_json(reply))


#: Bare words of JSON.
_WORDS = {"true": True, "false": False, "null": None}
_CUT_NUMBER = re.compile(r"-?\d*(?:\.\d*)?(?:[eE][+-]?\d*)?\Z")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def repaired_object(text: str, at: int) -> tuple[dict, int] | None:
    """The object that opens at ``at`` and where it ends; what the text's end cuts off is closed, a last comma is passed over; None if it isn't JSON.

    A stack of what is open, one step a token: an open object waits for a key, then for its value.
    """
    top: dict = {}
    stack: list[tuple] = [(top, None)]  # container, and the key whose value comes next
    i, ready = at + 1, True  # ready: a key, a value or a closing sign may come; else a comma or a closing sign
    while i < len(text):
        c = text[i]
        if c in " \t\r\n":
            i += 1
            continue
        into, key = stack[-1]
        closes = "}" if isinstance(into, dict) else "]"
        if c == closes and key is None:
            stack.pop()
            i += 1
            if not stack:
                return top, i
            ready = False
            continue
        if not ready:
            if c != ",":
                return None
            i, ready = i + 1, True
            continue
        if c == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            cut = j >= len(text)
            try:
                value = json.loads(text[i : j + 1] if not cut else text[i:].rstrip("\\") + '"', strict=False)
            except ValueError:
                if not cut:
                    return None
                value = text[i + 1 :]
            i = j + 1
            if isinstance(into, dict) and key is None:  # a key: cut off before its value, it is left out
                while i < len(text) and text[i] in " \t\r\n":
                    i += 1
                if i < len(text) and text[i] != ":":
                    return None
                stack[-1] = (into, value)
                i += 1
                continue
        elif isinstance(into, dict) and key is None:
            return None
        elif c in "{[":
            value = {} if c == "{" else []
            i += 1
        elif _CUT_NUMBER.match(text, i):  # the text ends in it, or in a part of it
            if not (number := _NUMBER.match(text, i)):
                return top, len(text)
            value, i = json.loads(number[0]), len(text)
        elif number := _NUMBER.match(text, i):
            value, i = json.loads(number[0]), number.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i) or (i + len(w) > len(text) and w.startswith(text[i:]))), None)
            if word is None:
                return None
            value, i = _WORDS[word], i + len(word)
        if isinstance(into, dict):
            into[key] = value
            stack[-1] = (into, None)
        else:
            into.append(value)
        ready = False
        if isinstance(value, (dict, list)):
            stack.append((value, None))
            ready = True
    return top, len(text)


def object_with(text: str | None, keys: list[str]) -> dict | None:
    """The first object, in the order in which they open, that has all of ``keys``, inside other objects and broken replies too."""
    text, at = text or "", 0
    while (at := text.find("{", at)) >= 0:
        found = repaired_object(text, at)
        if found is None:
            at += 1
            continue
        todo: list = [found[0]]
        while todo:
            value = todo.pop()
            if isinstance(value, dict) and all(k in value for k in keys):
                return value
            inner = list(value.values()) if isinstance(value, dict) else value
            todo += [v for v in reversed(inner) if isinstance(v, (dict, list))]
        at = max(found[1], at + 1)
    return None


def keyed_json(reply: Column | str, keys: list[str]) -> Column:
    """The object of a reply that has all of ``keys``, its own keys sorted; null without one. Prose around it, objects around it, braces in strings, last commas and a cut end do no harm."""

    def run(replies: pd.Series) -> pd.Series:
        found = [object_with(r, keys) for r in replies]
        return pd.Series([None if f is None else json.dumps(f, sort_keys=True) for f in found], dtype=object)

    return F.pandas_udf(run, "string")(F.col(reply) if isinstance(reply, str) else reply)
