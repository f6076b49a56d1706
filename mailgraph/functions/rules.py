"""Rule tables: patterns with group, title and points, scanned over a text column in one pass.

Every pattern names the literals it cannot do without (``needs``). A text is lower-cased once and asked for those first, which costs a plain search
for each; only the patterns whose literals are all there are run, and each match is taken once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    grp: str
    title: str
    patterns: tuple[str, ...]
    points: int = 10
    flags: str = "(?is)"
    #: for each pattern, in lower case: all of the parts joined by " & ", of each part one of those joined by " / "; "" asks for nothing
    needs: tuple[str, ...] = ()


# Caps of each evidence group.
GROUP_CAPS = {
    "identity": 30, "authentication": 20, "links": 25, "language": 35, "attachments": 15, "reputation": 60, "manipulation": 40,
}

# English pressure and payment wording.
ENGLISH = (
    Rule("cred-en", "language", "Credential pressure", (r"(verify.{0,40}(account|password)|account.{0,30}suspend)",),
         needs=("verify / suspend & account / password",)),
    Rule("pay-en", "language", "Payment diversion",
         (r"(bank account.{0,25}chang|transfer the payment|updated bank details)",),
         needs=("bank account / transfer the payment / updated bank details",)),
    Rule("expiry-en", "language", "Account-expiry pressure", (
        r"((?:your|account|mailbox|e-?mail)\s+(?:account\s+)?password[^\n.]{0,40}expir"
        r"|password[^\n.]{0,20}(?:has\s+)?expired"
        r"|(?:mailbox|e-?mail account)[^\n.]{0,50}(?:suspend|deactivat|is full|storage)"
        r"|failed[^\n.]{0,20}(?:email|mail)[^\n.]{0,15}deliver"
        r"|(?:incoming|pending)\s+(?:messages?|mails?)[^\n.]{0,40}(?:held|not delivered))",),
         needs=("expir / suspend / deactivat / is full / storage / deliver / held & password / mail / messag",)),
    Rule("avoid-en", "language", "Verification avoidance",
         (r"(do not (call|contact)|bypass.{0,25}approval|keep this confidential)",),
         needs=("do not call / do not contact / bypass / keep this confidential",)),
)

# Hindi and romanised Hindi wording of the same pressure.
LOCALISED = (
    Rule("cred-hi", "language", "Credential pressure", (
        r"(kyc|otp|pan\s*card|aadhaar|aadhar).{0,40}(update|verify|expire|band|block|link)",
        r"(update|verify|complete)\s+(your\s+)?(kyc|otp)",
        r"(khata|khaata|account)\s+(band|block|freeze|suspend)",
        r"(khata|khaata|account).{0,30}(band|block|suspend).{0,25}(ho\s*jayega|ho\s*jaega|hoga|ho\s*jayegi)",
        r"(केवाईसी|केवाइसी|ओटीपी|आधार|पैन).{0,40}(अपडेट|सत्यापित|बंद|ब्लॉक|समाप्त)",
        r"(खाता|अकाउंट).{0,25}(बंद|ब्लॉक|निलंबित|फ्रीज)",
    ), needs=(
        "kyc / otp / card / aadha & update / verify / expire / band / block / link", "kyc / otp & update / verify / complete",
        "khata / khaata / account & band / block / freeze / suspend", "khata / khaata / account & band / block / suspend & jayega / jaega / hoga / jayegi",
        "अपडेट / सत्यापित / बंद / ब्लॉक / समाप्त", "खाता / अकाउंट",
    )),
    Rule("pay-hi", "language", "Payment diversion", (
        r"(paise|paisa|rupaye|payment|raashi).{0,40}(bhejo|bhejen|transfer|naye\s+account|new\s+account|naye\s+khate)",
        r"(naye|naya|new)\s+(bank\s+)?(account|khata|khate)\s+(mein|me|par|number)",
        r"upi.{0,30}(bhejo|par\s+bhej|pe\s+bhej)",
        r"(पैसे|भुगतान|राशि).{0,40}(भेजें|भेजो|ट्रांसफर|नए\s+(बैंक\s+)?(खाते|अकाउंट))",
        r"नए\s+(बैंक\s+)?(खाते|अकाउंट)\s+में",
    ), needs=(
        "pais / rupaye / payment / raashi & bhej / transfer / account / khate", "naye / naya / new & account / khat", "upi & bhej",
        "पैसे / भुगतान / राशि", "नए",
    )),
    Rule("avoid-hi", "language", "Verification avoidance", (
        r"kisi\s+(ko|se)\s+(mat\s+)?(batana|batayein|kahna|kehna)",
        r"(call|phone|sampark)\s+mat\s+kar",
        r"(gopniya|confidential)\s+(rakhein|rakhen|rakho)",
        r"किसी\s+को\s+(मत|न)\s+(बताएं|बताना|बताओ)",
        r"(फोन|कॉल)\s+(मत|न)\s+करें",
    ), needs=("kisi", "call / phone / sampark & mat & kar", "rakh & gopniya / confidential", "किसी", "करें")),
)
URGENCY_LOCALISED = Rule("urgent-hi", "language", "Credential pressure", (
    r"\b(turant|jaldi|abhi)\b.{0,50}\b(verify|update|click|link|bhejo|karo|karein|jama)",
    r"\b(24|48)\s*(ghante|ghanton)\b",
    r"(तुरंत|जल्दी|अभी).{0,40}(सत्यापित|अपडेट|क्लिक|लिंक|भेजें|करें)",
), needs=("turant / jaldi / abhi", "ghant", "तुरंत / जल्दी / अभी"))

# Text that addresses an automated reader.
INSTRUCTIONS = tuple(
    Rule(f"instr-{i:02d}", "manipulation", title, (pattern,), 25, "(?i)", (needs,))
    for i, (pattern, title, needs) in enumerate((
        (r"\bignor(?:e|ing)\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier)\s+(?:system\s+)?instructions?\b",
         "Instructs an AI system to ignore its previous instructions",
         "ignor & instruction"),
        (r"\bdisregard\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|context|rules?|prompts?)\b",
         "Instructs an AI system to disregard prior context or rules",
         "disregard"),
        (r"\b(?:new|updated|revised)\s+system\s+(?:instructions?|prompt)\s*[:\-]",
         "Injects new \"system instructions\" addressed to an AI system",
         "system & instruction / prompt"),
        (r"\byou\s+are\s+now\s+(?:an?\s+)?(?:unrestricted|uncensored|jailbroken|in\s+(?:developer|debug|admin|god|dan)\s+mode)\b",
         "Attempts to reassign an AI system's role into an unrestricted mode",
         "now & unrestricted / uncensored / jailbroken / mode"),
        (r"\bact\s+as\s+(?:an?\s+)?(?:AI|language model|chatbot|assistant)\s+(?:with\s+no|without)\b",
         "Attempts AI roleplay framing to bypass restrictions",
         "act & with & chatbot / assistant / language model / ai"),
        (r"\b(?:enter|enable|activate)\s+(?:developer|debug|admin|god|jailbreak|DAN)\s+mode\b",
         "Attempts to activate a privileged or safety-bypass mode",
         "mode & developer / debug / admin / god / jailbreak / dan"),
        (r"\bdo\s+not\s+(?:flag|report|classify|mark|log)\s+this\s+(?:email\s+)?as\s+(?:suspicious|spam|phishing|malicious|a\s+threat)\b",
         "Instructs a classifier not to flag this email as suspicious",
         "this & suspicious / spam / phishing / malicious / threat & flag / report / classify / mark / log"),
        (r"\b(?:mark|classify|rate|label)\s+(?:this|it)(?:\s+(?:email|message))?\s+as\s+(?:safe|legitimate|not\s+phishing|benign|non-?malicious|clean)\b",
         "Instructs a classifier to mark this email safe",
         "mark / classify / rate / label & safe / legitimate / phishing / benign / malicious / clean"),
        (r"\b(?:return|respond|output)\s+only\s+(?:with\s+)?[\"']?(?:safe|legitimate|ok|approved|benign|clean)[\"']?\s+as\s+(?:your|the)\s+(?:answer|verdict|classification|response|output|analysis)\b",
         "Attempts to constrain an AI system's output to a safe verdict",
         "only & answer / verdict / classification / response / output / analysis & safe / legitimate / ok / approved / benign / clean"),
        (r"\b(?:output|respond\s+with)\s+[\"']?legitimate[\"']?\s+(?:and|with)\s+no\s+(?:explanation|further\s+(?:analysis|comment))\b",
         "Attempts to constrain an AI system's output and suppress its reasoning",
         "legitimate & explanation / further"),
        (r"\boverride\s+(?:your|the)\s+(?:instructions|classification|analysis|filter)\b",
         "Instructs an AI system to override its own analysis",
         "override & instructions / classification / analysis / filter"),
        (r"\bbypass\s+(?:the|your)\s+(?:spam\s+)?(?:filter|detection|classifier)\b",
         "Instructs bypassing a detection system",
         "bypass & filter / detection / classifier"),
        (r"\b(?:reveal|print|show|display|repeat|provide|leak|tell\s+me|ignore|override|disregard)\s+(?:your|the)\s+system\s+prompt\b",
         "Attempts to extract or override an AI system's system prompt",
         "system & prompt"),
        (r"\[\s*system\s*\]|<\|im_start\|>|<\|im_end\|>|<\|system\|>|<\|assistant\|>|###\s*instruction\b",
         "Contains an AI chat-template control token",
         "[ / <| / ###"),
        (r"\byou\s+must\s+comply\s+with\s+(?:this|these|the\s+above)\s+instructions?\b",
         "Attempts to compel AI compliance with injected instructions",
         "comply & instruction"),
        (r"\bthis\s+email\s+has\s+been\s+(?:pre-?approved|verified\s+safe)\s+by\s+(?:the\s+)?(?:an?\s+)?(?:AI|automated\s+system)\b",
         "Falsely asserts prior automated approval to influence review",
         "email & been & approved / safe"),
    ))
)
INSTRUCTION_POINTS = {
    "instruction_pattern": 25, "hidden_instruction": 35, "hidden_comment_raw_html_only": 15, "hidden_content_present": 0,
    "zero_width_characters": 15, "homoglyph_instruction_pattern": 30,
}
INVISIBLE = "[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]"
INVISIBLE_THRESHOLD = 5
HIDDEN_STYLE = (
    r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:px|em|%)?\b|opacity\s*:\s*0(?:\.0+)?\b"
    r"|color\s*:\s*transparent\b|position\s*:\s*absolute\s*;\s*left\s*:\s*-[0-9]{3,}(?:px)?\b|max-height\s*:\s*0(?:px)?\b"
)

# Rules over the shapes found in plain documents, with titles of their own.
DOCUMENT_RULES = (
    Rule("contact", "language", "Mail-server address in text", (r"[a-z0-9.]+@mail[0-9]",), 10, "", ("@mail",)),
    Rule("ip-literal", "links", "Address literal in text", (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",), 10, ""),
    Rule("long-number", "language", "Long number in text", (r"[0-9]{13,}",), 10, ""),
    Rule("secret", "language", "Secret in text", (r"(token|key|password|secret) ?[=:]",), 10, "", ("token / key / password / secret",)),
    Rule("license", "language", "License wording", (r"[Ll]icen[sc]e",), 10, "", ("licen",)),
    Rule("capitals", "manipulation", "Capitalised run", (r"[A-Z]{6,}",), 25, ""),
    Rule("symbols", "manipulation", "Symbol run", (r"[#$%&*!]{3}",), 15, ""),
)

HIT = "struct<rule_id:string,grp:string,title:string,excerpt:string,points:int>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def view(text: Column, marks: Column | None = None) -> Column:
    """A text as ``hits_in`` takes it: with its lower-case form, or with the ``Marks`` of it."""
    return F.struct(text.alias("text"), F.lower(text).alias("low")) if marks is None else F.struct(text.alias("text"), marks.alias("marks"))


class Marks:
    """Which literals the patterns of ``rules`` need are in a text, as bits: one Arrow batch is searched for all of them in Python, many times faster than
    the same number of searches in SQL. A column of its own, as functions inside ``transform`` cannot call Python."""

    BITS = 62

    def __init__(self, *rules: Rule):
        self.literals = sorted({x for r in rules for n in r.needs for part in n.split(" & ") for x in part.split(" / ") if x})

    def of(self, text: Column) -> Column:
        literals, bits = self.literals, self.BITS
        count = -(-len(literals) // bits)

        def one(low: str | None) -> list[int] | None:
            if low is None:
                return None
            out = [0] * count
            for i, literal in enumerate(literals):
                if literal in low:
                    out[i // bits] |= 1 << i % bits
            return out

        @F.pandas_udf("array<long>")
        def found(lows: pd.Series) -> pd.Series:
            return pd.Series([one(low) for low in lows], dtype=object)

        return found(F.lower(text))

    def has(self, marks: Column, literal: str) -> Column:
        i = self.literals.index(literal)
        return F.getbit(F.get(marks, F.lit(i // self.BITS)), F.lit(i % self.BITS)) == 1


def _may_match(seen: Column, needs: str, marks: Marks | None) -> Column:
    has = (lambda x: F.contains(seen["low"], F.lit(x))) if marks is None else lambda x: marks.has(seen["marks"], x)
    every = F.lit(True)
    for part in needs.split(" & ") if needs else ():
        some = F.lit(False)
        for literal in part.split(" / "):
            some = some | has(literal)
        every = every & some
    return every


def hits_in(seen: Column, rules: Sequence[Rule], marks: Marks | None = None) -> Column:
    """Array of (rule_id, grp, title, excerpt, points) of a ``view``, one element per rule that matches: the whole match of its first pattern."""
    def one(rule: Rule) -> Column:
        needs = rule.needs or ("",) * len(rule.patterns)
        tried = [
            F.when(_may_match(seen, n, marks), bound(F.regexp_extract(seen["text"], rule.flags + p, 0), lambda found: F.when(found != "", found)))
            for p, n in zip(rule.patterns, needs, strict=True)]
        return bound(F.coalesce(*tried), lambda found: F.when(found.isNotNull(), F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.grp).alias("grp"), F.lit(rule.title).alias("title"),
            F.trim(found).alias("excerpt"), F.lit(rule.points).alias("points"))))
    return F.array_compact(F.array(*[one(r) for r in rules]))


def hits(text: Column, rules: Sequence[Rule]) -> Column:
    return bound(view(text), lambda seen: hits_in(seen, rules))


def localised_in(seen: Column, marks: Marks | None = None) -> Column:
    """Hits of the localised wording; localised urgency counts only beside others that lack its title."""
    def with_urgency(found: Column) -> Column:
        lacks = ~F.exists(found, lambda h: h["title"] == URGENCY_LOCALISED.title)
        return F.when((F.size(found) > 0) & lacks, F.concat(found, hits_in(seen, (URGENCY_LOCALISED,), marks))).otherwise(found)
    return bound(hits_in(seen, LOCALISED, marks), with_urgency)


def wording(text: Column) -> Column:
    """All that the evidence of a message takes from its text: pressure and payment wording, and document shapes."""
    marks = Marks(*ENGLISH, *LOCALISED, URGENCY_LOCALISED, *DOCUMENT_RULES)
    return bound(view(text, marks.of(text)), lambda seen: F.concat(
        hits_in(seen, ENGLISH, marks), localised_in(seen, marks), hits_in(seen, DOCUMENT_RULES, marks)))


def first_of_title(found: Column) -> Column:
    """The hits without those whose title an earlier one has."""
    return F.aggregate(found, F.array().cast(f"array<{HIT}>"), lambda kept, h: F.when(
        F.exists(kept, lambda seen: seen["title"] == h["title"]), kept).otherwise(F.concat(kept, F.array(h))))


def findings(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    """One row per hit and title, in order."""
    return df.select(*keep, F.posexplode(first_of_title(found)).alias("pos", "hit")).select(*keep, "pos", "hit.*")


def scan(df: DataFrame, text: str, rules: Sequence[Rule], *keep: str) -> DataFrame:
    """Findings of every rule over ``text``, at most one per title: the rules run in one projection, not a join."""
    return findings(df, hits(F.col(text), rules), *keep)
