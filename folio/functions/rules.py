"""Patterns that formats and results depend on, each in Java's dialect and, for oracles, in RE2's."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    java: str
    re2: str | None = None  #: where RE2 can't say the same

    @property
    def plain(self) -> str:
        return self.re2 or self.java


# What is protected from translation, in order of precedence.
RULES = (
    Rule("code_span", r"`+[^`\n]*`+"),
    Rule("image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    Rule("footnote_ref", r"\[\^[^\]\n]{1,60}\]"),
    Rule("link_dest", r"\]\([^)\n]*\)"),
    Rule("ref_link", r"\]\[[^\]\n]*\]"),
    Rule("autolink", r"<(?:https?://|mailto:)[^>\s]+>"),
    Rule("html_tag", r"</?[A-Za-z][^>\n]{0,200}>"),
    Rule("math_display", r"\$\$.+?\$\$"),
    Rule("math_bracket", r"\\\[.+?\\\]"),
    Rule("math_paren", r"\\\(.+?\\\)"),
    Rule("math_inline", r"\$(?!\s)[^$\n]{1,200}?(?<!\s)\$", r"\$[^$\s](?:[^$\n]{0,198}?[^$\s])?\$"),
    Rule("url", r"\b(?:https?://|www\.)[^\s<>)\]]+"),
    Rule("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    Rule("section_no", r"\b\d+(?:\.\d+){1,4}\b"),
    Rule("lettered_no", r"\b[A-Z]\.\d+(?:\.\d+){0,3}\b"),
    Rule("snake_case", r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+){1,}\b"),
    Rule("notation", r"\b[A-Za-zΘΩΛ]\([^)\n]{1,20}\)"),
)

# Placeholder styles (before the number, behind it, pattern with the number as group 1).
STYLES = {
    "curly": ("{{v", "}}", r"\{\{\s*[vV]?\s*(\d{1,4})\s*\}\}"),
    "square": ("[[", "]]", r"\[\[\s*(\d{1,4})\s*\]\]"),
}

# Candidate terms, and words that are none.
TERM = r"\b[A-Z][a-zA-Z0-9]{2,}(?:\s+[A-Z][a-zA-Z0-9]{2,}){0,3}\b"
STOPWORDS = tuple(
    "The This That These Those There Then They Their When Where What Which While With Without Here For From But And Not You Your One Two Three First Second Third "
    "Next Last Chapter Section Figure Table Note Example Exercise Part Page See Its It If In On At As An A Is Are Was Were Be Can May Must Should Would Could We Our He She".split()
)

# Scan furniture and chart ticks.
WATERMARK = r"anyscanner|camscanner|tapscanner|scanner\s*pro|genius\s*scan|adobe\s*scan|^scan$|^cs$"
AXIS_TICK = r"^[-+]?[\d\s.,:;']+$|^[\d\s]+\w{0,4}\s*[\d']{1,4}\s*[:.]\d{2}$"
CHAPTER_LINE = r"^(chapter|part|appendix|section|book|walk)\s+(\d{1,3}|[ivxlcdm]{1,7}|one|two|three|four|five|six|seven|eight|nine|ten)\b"

# Nine places of a label on a figure, and their names in the book's language.
POSITIONS = {
    "top-left": "أعلى اليسار",
    "top-centre": "أعلى الوسط",
    "top-right": "أعلى اليمين",
    "middle-left": "الوسط الأيسر",
    "middle-centre": "الوسط",
    "middle-right": "الوسط الأيمن",
    "bottom-left": "أسفل اليسار",
    "bottom-centre": "أسفل الوسط",
    "bottom-right": "أسفل اليمين",
}
LEGEND_TITLE = "مفتاح الشكل"


#: Signs of which a text needs one for any rule to find something in it.
NEEDED = r"[`\[\]<$\\_.:@(]"

#: What the rules that start with a sign start with, and what follows the first letters and digits of all others.
_SIGNS, _AFTER = r"[`!\[\]<$\\]", r"[_.:@(+\-]"


def java() -> str:
    """All rules as one alternation, so that no rule sees inside what another has protected.

    A rule starts with a sign or at a word's edge. Two looks ahead spare most places the trial of each rule.
    """
    signs = [f"(?:{r.java})" for r in RULES if not r.java.startswith(r"\b")]
    words = [f"(?:{r.java})" for r in RULES if r.java.startswith(r"\b")]
    return f"(?sU)(?={_SIGNS})(?:{'|'.join(signs)})|\\b(?=[^\\W_]*+{_AFTER})(?:{'|'.join(words)})"


def re2() -> str:
    return "(?s)" + "|".join(f"(?:{r.plain})" for r in RULES)
