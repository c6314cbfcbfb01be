"""Slow and plain versions of the banner clean-up, a page and a line at a time."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

SMALL_WORDS = {"and", "at", "for", "in", "ku", "of", "on", "the", "to"}
NUMERAL = re.compile(r"m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
COURSE = re.compile(r"\b[A-Z]{2,6}\s*[/-]?\s*(?!(?:19|20)\d{2}\b)\d{2,4}[A-Z]{0,3}\b", re.A)
MARKS = "COURSE CODE|EXPERIMENT|MODULE|TABLE DATA|UNIT|WEEK|CIRCULAR|EXAM|FEE|NOTIFICATION|OFFICE ORDER|QUOTATION|REGULATION|SCHOLARSHIP|SYLLABUS|TENDER|TIME TABLE|TIMETABLE".split("|")
BANNERS = "CAMPUS|COLLEGE|DEPARTMENT|FACULTY|INSTITUTE|UNIVERSITY|ACADEMIC YEAR|BACHELOR|CURRICULUM|MASTER|SEMESTER|SYLLABUS|BTECH|B TECH|B.TECH|B. TECH|MTECH|M TECH|M.TECH|M. TECH".split("|")
STRUCTURE = set("circular exam examination experiment experiments lab laboratory module notification objective objectives outcome outcomes syllabus timetable unit week weeks".split())


def split_lines(text: str | None) -> list[str]:
    parts = re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text or "")
    return parts[:-1] if parts[-1] == "" else parts


def token_list(line: str) -> list[str]:
    words = " ".join(re.findall("[a-z0-9]+", line.lower()))
    words = re.sub(r"\b([bm]) tech\b", r"\1tech", words).split()
    return [w for w in words if len(w) > 1 and w not in SMALL_WORDS and not re.search("[0-9]", w) and not NUMERAL.fullmatch(w)]


def tabular(line: str) -> bool:
    return "|" in line or line.strip().upper().startswith("[TABLE")


def must_stay(line: str) -> bool:
    up = line.upper()
    if not line.strip() or tabular(line) or any(m in up for m in MARKS):
        return True
    banner = any(b in up for b in BANNERS) or re.search(r"\b[0-9]{6}\b", up, re.A)
    return bool(COURSE.search(up)) and not banner


def likeness(a: set, b: set) -> tuple[float, float]:
    both = len(a & b)
    return both / len(a | b), both / min(len(a), len(b))


def alike(a: set, b: set) -> bool:
    jaccard, overlap = likeness(a, b)
    return jaccard >= 0.6 or overlap >= 0.8


def lines_of(words: list[tuple], tolerance: float = 5.0) -> list[str]:
    """Words (top, x0, text) as lines."""
    out: list[list[tuple]] = []
    for w in sorted(words):
        if not out or w[0] - out[-1][0][0] > tolerance:
            out.append([])
        out[-1].append(w)
    return [" ".join(" ".join(t for _, _, t in sorted(line, key=lambda w: (w[1], w[0], w[2]))).split()) for line in out]


def layout(text: str | None) -> tuple[list[tuple], float]:
    """The words of a page as the catalog's queries lay them out, and the page's height."""
    lines = split_lines(text)
    words = []
    for y, line in enumerate(lines):
        words += [(12.0 * y + 2.0 * (k % 3), 10.0 * k, w) for k, w in enumerate(w for w in line.split(" ") if w)]
    return words, 12.0 * len(lines)


def candidates(text: str | None) -> list[tuple[str, str]]:
    words, height = layout(text)
    if height <= 0:
        return []
    out = []
    for zone, own in (("header", [w for w in words if w[0] <= 0.15 * height]), ("footer", [w for w in words if w[0] >= (1 - 0.12) * height])):
        for line in lines_of(own):
            tokens = set(token_list(line))
            if not must_stay(line) and len(tokens) >= 2 and not tokens & STRUCTURE:
                out.append((zone, line))
    return out


def clusters(pages: list[tuple[int, str | None]]) -> list[dict]:
    found: list[dict] = []
    for number, text in pages:
        for zone, line in candidates(text):
            own = set(token_list(line))
            best, score = None, 0.0
            for c in found:
                if c["zone"] == zone and alike(own, c["core"]) and max(likeness(own, c["core"])) > score:
                    best, score = c, max(likeness(own, c["core"]))
            if best is None:
                best = {"zone": zone, "core": own, "pages": set(), "raw": Counter()}
                found.append(best)
            best["core"] = best["core"] & own
            best["pages"].add(number)
            best["raw"][line] += 1
    return found


def shown(raw: Counter) -> str:
    least = max(1, math.ceil(max(raw.values()) / 2))
    return min((sum(c.isdigit() for c in r), sum(not c.isalnum() and not c.isspace() for c in r), len(r), r) for r, n in raw.items() if n >= least)[3]


def patterns(pages: list[tuple[int, str | None]], threshold: float) -> list[tuple[str, str, set, str, int]]:
    """(zone, label, tokens, representative, pages) in the order in which a line tries them."""
    least = max(2, math.ceil(threshold * len(pages)))
    return [(c["zone"], " ".join(sorted(c["core"])), c["core"], shown(c["raw"]), len(c["pages"])) for c in clusters(pages) if len(pages) > 1 and len(c["pages"]) >= least and len(c["core"]) >= 2]


def cleaned(pages: list[tuple[int, str | None]], threshold: float) -> tuple[dict[int, str], list[str]]:
    """Text of each page, and the representatives of what was removed."""
    found, texts, hits = patterns(pages, threshold), {}, defaultdict(set)
    for number, text in pages:
        lines = split_lines(text)
        counted = [k for k, line in enumerate(lines) if line.strip() and not tabular(line)]
        head, foot = set(counted[:10]), set(counted[-5:])
        left = []
        for k, line in enumerate(lines):
            zone = "header" if k in head else "footer" if k in foot else None
            own = set(token_list(line))
            label = None
            if zone and len(own) >= 2 and not must_stay(line.strip()):
                label = next((name for z, name, tokens, _, _ in found if z == zone and alike(own, tokens)), None)
            if label is None:
                left.append(line)
            else:
                hits[label].add(number)
        texts[number] = "\n".join(left).strip()
    order = sorted((p for p in found if hits[p[1]]), key=lambda p: (-len(hits[p[1]]), p[0], p[1]))
    return texts, list(dict.fromkeys(p[3] for p in order))
