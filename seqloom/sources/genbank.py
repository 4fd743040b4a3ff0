"""GenBank flat-file records: one record's text to a row and back, and the grammar of locations."""

from __future__ import annotations

import re

SEGMENT = "array<struct<ord:int,seg_start:bigint,seg_end:bigint,complement:boolean>>"
FEATURE = f"struct<feature_type:string,gbk_location_string:string,complement:boolean,joined:boolean,five_prime_partial:boolean,three_prime_partial:boolean,start_pos:bigint,end_pos:bigint,segments:{SEGMENT},attributes:map<string,string>>"
REFERENCE = "struct<authors:string,title:string,journal:string,pub_med:string,remark:string,bases_range:string,consortium:string>"
LOCUS = "struct<locus_name:string,sequence_length:string,molecule_type:string,genbank_division:string,modification_date:string,sequence_coding:string,circular:boolean>"
RECORD_SCHEMA = (
    f"locus {LOCUS}, definition string, accession string, version string, keywords string, source string, organism string, taxonomy array<string>, "
    f"refs array<{REFERENCE}>, base_count array<struct<base:string,base_n:int>>, other map<string,string>, sequence string, features array<{FEATURE}>, error string"
)
RECORD_FIELDS = ["locus", "definition", "accession", "version", "keywords", "source", "organism", "taxonomy", "refs", "base_count", "other", "sequence", "features", "error"]

# Kinds of molecule and divisions, in the order in which they are tried.
MOLECULES = ["DNA", "genomic DNA", "genomic RNA", "mRNA", "tRNA", "rRNA", "other RNA", "other DNA", "transcribed RNA", "viral cRNA", "unassigned DNA", "unassigned RNA"]
DIVISIONS = ["PRI", "ROD", "MAM", "VRT", "INV", "PLN", "BCT", "VRL", "PHG", "SYN", "UNA", "EST", "PAT", "STS", "GSS", "HTG", "HTC", "ENV"]
_REFERENCE_KEYS = {"AUTHORS": "authors", "TITLE": "title", "JOURNAL": "journal", "PUBMED": "pub_med", "REMARK": "remark", "CONSRTM": "consortium"}


def parse_location(text: str) -> dict:
    """complement (of the whole), joined, partial ends, outer bounds, and segments in order with their own strand.

    0-based and half-open. A single base is a segment of one letter, a place between two bases an empty one; order() reads
    as join(). Groups within groups are resolved: turning a group turns its segments and their order. Bad text raises ValueError.
    """
    s = re.sub(r"\s+", "", text)
    at = 0
    joined = False

    def group() -> list[tuple[int, int, bool]]:
        nonlocal at, joined
        if s.startswith("complement(", at):
            at += 11
            inner = group()
            close()
            return [(a, b, not c) for a, b, c in reversed(inner)]
        if m := re.compile(r"(?:join|order)\(").match(s, at):
            at, joined = m.end(), True
            parts = group()
            while s.startswith(",", at):
                at += 1
                parts += group()
            close()
            return parts
        m = re.compile(r"[<>]?(\d+)(?:(\.\.|\^)[<>]?(\d+)[<>]?)?[<>]?").match(s, at)
        if not m:
            raise ValueError(f"bad location {text!r}")
        at = m.end()
        a, b = int(m[1]), int(m[3] or m[1])
        return [(a, a, False)] if m[2] == "^" else [(a - 1, b, False)]

    def close() -> None:
        nonlocal at
        if not s.startswith(")", at):
            raise ValueError(f"bad location {text!r}")
        at += 1

    whole = s.startswith("complement(")
    segments = group()
    if at != len(s):
        raise ValueError(f"bad location {text!r}")
    if whole:  # kept apart, as the strand of the feature
        segments = [(a, b, not c) for a, b, c in reversed(segments)]
    return {
        "gbk_location_string": s, "complement": whole, "joined": joined, "five_prime_partial": "<" in s, "three_prime_partial": ">" in s,
        "start_pos": min(a for a, _, _ in segments), "end_pos": max(b for _, b, _ in segments),
        "segments": [{"ord": i, "seg_start": a, "seg_end": b, "complement": c} for i, (a, b, c) in enumerate(segments)],
    }


def location_string(f: dict) -> str:
    """The text of a location; partial marks stand at its outer ends."""
    segments = f["segments"] or []

    def one(g, first, last):
        low = "<" if first and f.get("five_prime_partial") else ""
        high = ">" if last and f.get("three_prime_partial") else ""
        body = f"{low}{g['seg_start'] + 1}..{high}{g['seg_end']}"
        return f"complement({body})" if g["complement"] else body

    parts = [one(g, i == 0, i == len(segments) - 1) for i, g in enumerate(segments)]
    body = parts[0] if len(parts) == 1 else f"join({','.join(parts)})"
    return f"complement({body})" if f.get("complement") else body


def parse_locus(line: str) -> dict:
    words = line.split()
    size = re.search(r"(\d+) (bp|aa)", line)
    date = re.search(r"\d{2}-[A-Z]{3}-\d{4}", line)
    rest = f" {' '.join(words[2:])} "
    return {
        "locus_name": words[1] if len(words) > 1 else "", "sequence_length": size[1] if size else "", "sequence_coding": size[2] if size else "",
        "molecule_type": next((m for m in MOLECULES if m in rest), ""), "genbank_division": next((d for d in DIVISIONS if f" {d} " in rest), ""),
        "modification_date": date[0] if date else "", "circular": " circular " in rest,
    }


def _features(lines: list[str]) -> list[dict]:
    out: list[dict] = []
    indent = 0
    for line in lines:
        text = line.strip()
        if not text:
            continue
        depth = len(line) - len(line.lstrip())
        if not out or depth < indent:  # less indented than what went before: a new feature
            name, _, where = text.partition(" ")
            out.append({"feature_type": name, "where": where.strip(), "attributes": {}, "key": None})
            indent = len(line) - len(where.lstrip()) if where.strip() else depth + 1
            continue
        f = out[-1]
        open_text = f["key"] is not None and f["attributes"][f["key"]].count('"') % 2 == 1
        if text.startswith("/") and not open_text:
            key, _, value = text[1:].partition("=")
            f["key"] = key
            f["attributes"][key] = value
        elif f["key"] is None:
            f["where"] += text
        else:
            f["attributes"][f["key"]] += text
    for f in out:
        f["attributes"] = {k: v.replace('"', "") for k, v in f["attributes"].items()}
        f |= parse_location(f.pop("where"))
        del f["key"]
    return out


def parse_record(text: str) -> dict | None:
    """A record's row; None if the text holds no LOCUS line. What doesn't parse leaves ``error`` and the parts read so far."""
    lines = text.replace("\r", "").split("\n")
    first = next((i for i, x in enumerate(lines) if x.startswith("LOCUS")), None)
    if first is None:
        return None
    row: dict = {"locus": parse_locus(lines[first]), "taxonomy": [], "refs": [], "base_count": [], "other": {}, "features": [], "sequence": "", "error": None}
    blocks: list[tuple[str, list[str]]] = []
    for x in lines[first + 1 :]:
        if x.startswith("//"):
            break
        if x[:1] not in ("", " "):
            blocks.append((x.split()[0], [x]))
        elif blocks:
            blocks[-1][1].append(x)
    for key, body in blocks:
        head = body[0][len(key) :].strip()
        rest = [head, *(x.strip() for x in body[1:])]
        joined = " ".join(x for x in rest if x) or "."
        try:
            if key == "FEATURES":
                row["features"] = _features(body[1:])
            elif key == "ORIGIN":
                row["sequence"] = re.sub("[^A-Za-z]", "", "".join(body[1:]))
            elif key == "BASE":
                words = body[0].split()[2:]
                row["base_count"] = [{"base": b, "base_n": int(n)} for n, b in zip(words[::2], words[1::2])]
            elif key == "SOURCE":
                at = next((i for i, x in enumerate(body) if x.strip().startswith("ORGANISM")), None)
                row["source"] = " ".join(x.replace("SOURCE", "", 1).strip() if i == 0 else x.strip() for i, x in enumerate(body[:at])) if at is not None else joined
                if at is not None:
                    row["organism"] = body[at].strip()[8:].strip()
                    tail = " ".join(x.strip() for x in body[at + 1 :]).rstrip(".")
                    row["taxonomy"] = [t.strip() for t in tail.split(";") if t.strip()]
            elif key == "REFERENCE":
                bounds = re.search(r"\(.*\)", body[0])
                ref = {"bases_range": bounds[0] if bounds else ""}
                name = None
                for x in body[1:]:
                    word = x.strip().split(" ")[0]
                    if len(x) - len(x.lstrip()) < 10 and word in _REFERENCE_KEYS:
                        name = _REFERENCE_KEYS[word]
                        ref[name] = x.strip()[len(word) :].strip()
                    elif name:
                        ref[name] = f"{ref[name]} {x.strip()}"
                row["refs"].append(ref)
            elif key in ("DEFINITION", "ACCESSION", "VERSION", "KEYWORDS"):
                row[key.lower()] = joined
            else:
                row["other"][key] = joined
        except ValueError as e:
            row["error"] = str(e)
    return row


def _wrap(key: str, text: str, width: int = 68) -> list[str]:
    words, lines, now = (text or "").split(" "), [], ""
    for w in words:
        if now and len(now) + 1 + len(w) > width:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}" if now else w
    return [f"{key:<12}{x}" if i == 0 else " " * 12 + x for i, x in enumerate([*lines, now])]


def build_record(r: dict) -> str:
    """A record's text. Other meta data and qualifiers come sorted by key."""
    lo = r.get("locus") or {}
    out = [
        f"LOCUS       {lo.get('locus_name') or '':<16} {lo.get('sequence_length') or len(r.get('sequence') or ''):>11} {lo.get('sequence_coding') or 'bp'} {lo.get('molecule_type') or '':>7} "
        f"{'circular' if lo.get('circular') else 'linear':<8} {lo.get('genbank_division') or ''} {lo.get('modification_date') or ''}".rstrip()
    ]
    for key in ("definition", "accession", "version", "keywords"):
        out += _wrap(key.upper(), r.get(key) or ".")
    out += _wrap("SOURCE", r.get("source") or ".") + _wrap("  ORGANISM", r.get("organism") or ".")
    if r.get("taxonomy"):
        out += _wrap("", "; ".join(r["taxonomy"]) + ".")
    for i, ref in enumerate(r.get("refs") or [], 1):
        out.append(f"REFERENCE   {i}  {ref.get('bases_range') or ''}".rstrip())
        for word, name in _REFERENCE_KEYS.items():
            if ref.get(name):
                out += _wrap(f"  {word}", ref[name])
    for key, value in sorted((r.get("other") or {}).items()):
        out += _wrap(key, value)
    if r.get("base_count"):
        out.append("BASE COUNT  " + " ".join(f"{b['base_n']} {b['base']}" for b in r["base_count"]))
    out.append("FEATURES             Location/Qualifiers")
    for f in r.get("features") or []:
        out.append(f"     {f['feature_type']:<16}{f.get('gbk_location_string') or location_string(f)}")
        out += [f'                     /{k}="{v}"' if v else f"                     /{k}" for k, v in sorted((f.get("attributes") or {}).items())]
    s = r.get("sequence") or ""
    out.append("ORIGIN")
    out += [f"{i + 1:>9} " + " ".join(s[j : j + 10] for j in range(i, min(i + 60, len(s)), 10)) for i in range(0, len(s), 60)]
    return "\n".join([*out, "//", ""])
