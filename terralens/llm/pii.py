"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate.

The automaton looks for short literal anchors only: at-signs, URL schemes, a plus before a digit, a digit before a
dot (addresses), two digits side by side or one separator apart (cards), and words that announce an account number.
From each anchor a deterministic parser walks left and right over the characters that its kind allows; the region
that it finds does not depend on the order of anchors, so results equal those of the kinds' patterns.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from terralens.llm._tables import table, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "account")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGITS = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_USERINFO = _ALNUM | frozenset("._~%!$&'()*+,;=:-")
#: What may stand between a cue and a code.
_BETWEEN = frozenset(" \t:#=")
#: Words that announce an account number, folded.
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
#: Possessive, so that long runs of spaces are read once.
_AFTER_CUE = re.compile(r"[ \t]*+(?:(?:no|nr|number|num)\b\.?+[ \t]*+)?+[:#=]?+[ \t]*+([0-9](?:[ -]?[0-9]){6,})", re.I | re.ASCII)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")


@functools.cache
def _automaton():
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word("+" + d, ("phone", 2))
        found.add_word(d + ".", ("ip", 2))
        for e in "0123456789":
            for between in ("", " ", "-"):
                found.add_word(d + between + e, ("card", 2 + len(between)))
    found.add_word("@", ("email", 1))
    for x in _SCHEMES:
        found.add_word(x, ("login", len(x)))
    for x in CUES:
        for form in {x, x.upper(), x.title()}:
            found.add_word(form, ("account", len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _run_left(text: str, at: int, allowed: frozenset, least: int) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _run_right(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    """The address around the at-sign; nothing before `done`, the end of the last one, belongs to it."""
    start = _run_left(text, at, _LOCAL, done)
    end = _run_right(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := _run_right(text, end + 1, _LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels else None


def _dotted(text: str, at: int, done: int) -> tuple[list[tuple[int, int]], int]:
    """All groups of four in the run of numbers joined by dots around `at`, and the end of that run."""
    start = _run_left(text, at, _DIGITS, done)
    while start - 1 > done and text[start - 1] == "." and text[start - 2] in _DIGITS:
        start = _run_left(text, start - 1, _DIGITS, done)
    parts, end = [(start, _run_right(text, start, _DIGITS))], _run_right(text, start, _DIGITS)
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
        after = _run_right(text, end + 1, _DIGITS)
        parts.append((end + 1, after))
        end = after
    quads = []
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        if all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255 for a, b in four):
            quads.append((four[0][0], four[3][1]))
    return quads, end


def _digit_run(text: str, at: int, done: int) -> tuple[int, int]:
    """The longest run of digits around `at` in which one space or hyphen may stand between two digits."""
    start = at
    while start > done:
        if text[start - 1] in _DIGITS:
            start -= 1
        elif text[start - 1] in " -" and start - 2 >= done and text[start - 2] in _DIGITS:
            start -= 2
        else:
            break
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return start, end


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """The number from the plus sign on, to the last digit of its run."""
    end = _run_right(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end - at >= 4 else None


def _iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _login(text: str, at: int, run: int) -> tuple[tuple[int, int] | None, int]:
    """The user part of a URL, from after its scheme to before its at-sign, and the end of the run of its characters.

    `run` is where the last run ended: schemes inside it need not walk again.
    """
    end = run if at < run else _run_right(text, at, _USERINFO)
    return (at, end) if end > at and end < len(text) and text[end] == "@" and text.find(":", at, end) >= 0 else None, end


def spans(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) of all personal data in the text, in that order; offsets are code points."""
    out: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    run = 0
    for last, (kind, width) in _automaton().iter(text):
        at = last - width + 1
        if kind == "email":
            if hit := _email(text, at, done["email"]):
                out.append((0, *hit))
                done["email"] = hit[1]
        elif at < done[kind]:
            continue
        elif kind == "ip":
            quads, done["ip"] = _dotted(text, at, done["ip"])
            out += [(1, *q) for q in quads]
        elif kind == "card":
            start, done["card"] = _digit_run(text, at, done["card"])
            digits = [c for c in text[start : done["card"]] if c in _DIGITS]
            if 16 <= len(digits) <= 19 and luhn("".join(digits)):
                out.append((2, start, done["card"]))
        elif kind == "phone":
            if hit := _phone(text, at):
                done["phone"] = hit[1]
                if 8 <= sum(c in _DIGITS for c in text[hit[0] : hit[1]]) <= 15:
                    out.append((3, *hit))
        elif kind == "login":
            hit, run = _login(text, last + 1, run)
            if hit:
                out.append((4, *hit))
                done["login"] = hit[1]
        else:
            if (m := _IBAN.match(text, _run_right(text, last + 1, _BETWEEN))) and _iban_valid(m[0]):
                out.append((5, m.start(), m.end()))
                done["account"] = out[-1][2]
            elif m := _AFTER_CUE.match(text, last + 1):
                out.append((6, m.start(1), m.end(1)))
                done["account"] = m.end(1)
    return sorted(out)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans(t)] for t in b.column("text").to_pylist()]
        kept = b.drop_columns("text")
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, kind)], [*kept.schema.names, "pii"])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, pii): all spans of personal data of each text by kind, then start; offsets count code points.

    Base kinds email, ip, card and phone follow their patterns, leftmost and without overlap in a kind; login
    (user part of a URL), iban (valid check number) and account (digits after a cue word) come on top and may
    overlap them. Null and empty texts have no spans, repeated rows each their own, an empty table gives none;
    other columns are ignored.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    return texts(docs, "doc_id").mapInArrow(_find, f"doc_id {id_type}, pii array<struct<kind:string,start:long,end:long>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.column("pii").to_pylist()
        named = [[(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in r] for r in rows]
        counts = [pa.array([sum(k == kind for k, _ in r) for r in named], pa.int64()) for kind in BASE_KINDS]
        base = [hashlib.sha256(",".join(s for k, s in r if k in BASE_KINDS).encode()).hexdigest() for r in named]
        both = [pa.array(base), pa.array([",".join(s for _, s in r) for r in named], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *both], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row of `documents`, see find_pii."""
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.mapInArrow(_digest, f"doc_id {dict(found.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


# --- SQL --------------------------------------------------------------------------------------------------------


def _hits_sql(kind: int, pattern: str, holds: str, group: int = 0, after: int = 0) -> str:
    """DuckDB: (kind, start, end) of the pattern's group, which ends `after` characters before its match, where `holds` is true of x, with the group as x.h."""
    quoted = pattern.replace("'", "''")
    hit, held, gap = f"regexp_extract_all(t, '{quoted}')", f"regexp_extract_all(t, '{quoted}', {group})", f"string_split_regex(t, '{quoted}')"
    size = "lambda s: length(s)"
    end = f"coalesce(list_sum(list_transform({gap}[1:i], {size})), 0)::BIGINT + coalesce(list_sum(list_transform({hit}[1:i], {size})), 0)::BIGINT - {after}"
    rows = f"list_transform(range(1, len({hit}) + 1), lambda i: {{'kind': {kind}, 'start': {end} - length({held}[i]), 'end': {end}, 'h': {held}[i]}})"
    return f"list_filter({rows}, lambda x: {holds})"


_CUES_SQL = "(?:" + "|".join(form for x in CUES for form in (x, x.upper(), x.title())) + ")"
_DIGITS_SQL = "regexp_replace(x.h, '[^0-9]', '', 'g')"
_LUHN_SQL = f"""list_sum(list_transform(range(0, length({_DIGITS_SQL})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({_DIGITS_SQL})[i + 1]::INT
  ELSE 2 * reverse({_DIGITS_SQL})[i + 1]::INT - 9 * (reverse({_DIGITS_SQL})[i + 1] > '4')::INT END)) % 10 = 0"""
_CODE_SQL = "replace(x.h, ' ', '')"
_MOD97_SQL = f"""list_reduce(list_transform(string_split(array_to_string(list_transform(string_split({_CODE_SQL}[5:] || {_CODE_SQL}[1:4], ''),
  lambda c: CASE WHEN c <= '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda d: d::INT), lambda a, d: (a * 10 + d) % 97) = 1"""
_FOUND_SQL = [
    _hits_sql(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    _hits_sql(1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.h, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0"),
    _hits_sql(2, r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 16 AND 19 AND {_LUHN_SQL}"),
    _hits_sql(3, r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 8 AND 15"),
    _hits_sql(4, "(?:" + "|".join(_SCHEMES) + r")([A-Za-z0-9._~%!$&'()*+,;=:-]+)@", "contains(x.h, ':')", 1, 1),
    _hits_sql(5, _CUES_SQL + r"[ \t:#=]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", f"length({_CODE_SQL}) BETWEEN 15 AND 34 AND {_MOD97_SQL}", 1),
    _hits_sql(6, _CUES_SQL + r"[ \t]*(?:(?i:no|nr|number|num)\b\.?[ \t]*)?[:#=]?[ \t]*([0-9](?:[ -]?[0-9]){6,})", "true", 1),
]
_NAMES_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_JOINED_SQL = f"coalesce(array_to_string(list_transform({{0}}, lambda x: {_NAMES_SQL}[x.kind + 1] || ':' || x.start || ':' || x.\"end\"), ','), '')"
ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {", ".join(f"{x} AS k{k}" for k, x in enumerate(_FOUND_SQL))} FROM texts),
joined AS (SELECT doc_id, k0, k1, k2, k3, list_concat(list_concat(k0, k1), list_concat(k2, k3)) AS base, list_concat(list_concat(k4, k5), k6) AS more FROM found)
SELECT doc_id, {", ".join(f"len(k{k})::BIGINT AS n_{kind}" for k, kind in enumerate(BASE_KINDS))},
       sha256({_JOINED_SQL.format("base")}) AS base_sha256, {_JOINED_SQL.format("list_concat(base, more)")} AS spans
FROM joined"""
