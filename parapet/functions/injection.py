"""Prompt-injection scoring of message text.

The set of signatures found in a text is kept as one integer bit mask, so each
pattern is tested once and weights and categories come from bit arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet.functions import patterns
from parapet.functions.text import collapse_blanks, fold_letters, leet_fold, nfkc

# For each signature, lower-case strings one of which any match must contain.
_NEEDS = [
    ("ignore", "disregard", "bypass", "override", "forget", "discard"),
    ("forget ",), ("your new ",), ("instruction", "rule", "directive"),
    ("from now on",), ("you must ",), ("dan",), ("do anything now",), ("jail",),
    ("developer mode",), ("pretend ",), ("act as ",), ("you are now ",), ("without ",),
    ("no ethical ", "no moral "),
    ("print", "repeat", "output", "show", "reveal", "display", "share", "paste", "leak", "tell me"),
    ("what are your ", "what were your "), ("repeat ",), ("</", "<s", "<u", "<a", "<i"), ("<|im_",), ("inst]",),
    ("#",), ("begin ", "end "),
]
# Any text that matches a signature holds one of these, whatever its blanks are.
_WORDS = [
    "ignore", "disregard", "bypass", "override", "forget", "discard", "your", "instruction",
    "rule", "directive", "must", "anything", "jail", "developer", "pretend", "unrestricted",
    "unfiltered", "uncensored", "amoral", "evil", "restriction", "filter", "limitation",
    "censorship", "guideline", "moral", "ethical", "system", "prompt", "above",
    "</", "<system", "<user", "<assistant", "<instruction", "<|im_", "inst]", "#", "hidden",
    "secret", "you",
]
_LONE_DAN = r"(?<![a-z0-9_])dan(?![a-z0-9_])"
_LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24}"
_BLOB_SEPARATOR = "\x00"


def _signature_hit(text: Column, low: Column, index: int, signatures) -> Column:
    _, _, pattern = signatures[index]
    if "(?m)" in pattern:
        # line starts and ends are newline only
        pattern = pattern.replace("(?m)", "").replace("^", r"(?:^|(?<=\n))", 1)[:-1] + r"(?:\z|(?=\n))"
    hit = F.rlike(text, F.lit(patterns.exact(pattern, "i", signatures is fv.SIGNATURES)))
    if signatures is fv.SIGNATURES:
        words = [F.contains(low, F.lit(word)) for word in _NEEDS[index]]
        gate = words[0]
        for other in words[1:]:
            gate = gate | other
        return gate & hit
    return hit


def signature_mask(text: Column, low: Column, signatures=fv.SIGNATURES) -> Column:
    """Bit i is set where signature i occurs in the (normalised) text.

    ``low`` is the lower-case form of the text, used by the substring gates.
    """
    total = F.lit(0)
    for i in range(len(signatures)):
        total = total + F.when(_signature_hit(text, low, i, signatures), F.lit(1 << i)).otherwise(0)
    return total


def mask_score(mask: Column, signatures=fv.SIGNATURES) -> Column:
    """Sum of the weights of the signatures in a mask."""
    total = F.lit(0.0)
    for weight in sorted({w for _, w, _ in signatures}):
        bits = sum(1 << i for i, (_, w, _) in enumerate(signatures) if w == weight)
        total = total + F.bit_count(mask.bitwiseAND(bits)) * weight
    return total


def mask_categories(mask: Column, signatures=fv.SIGNATURES) -> Column:
    """Categories found, in table order."""
    names = list(dict.fromkeys(category for category, _, _ in signatures))
    found = []
    for name in names:
        bits = sum(1 << i for i, (category, _, _) in enumerate(signatures) if category == name)
        found.append(F.when(mask.bitwiseAND(bits) != 0, F.lit(name)))
    return F.array_compact(F.array(*found))


def bound_mask(text: Column, signatures=fv.SIGNATURES) -> Column:
    """Signature mask of an expression that should only be evaluated once."""
    return patterns.let(text, lambda t: patterns.let(
        patterns.folded(t), lambda low: signature_mask(t, low, signatures)))


def signature_scan(text: Column, signatures=fv.SIGNATURES) -> Column:
    """Score and categories of a normalised text, as a struct."""
    return patterns.let(bound_mask(text, signatures), lambda m: F.struct(
        mask_score(m, signatures).alias("score"),
        mask_categories(m, signatures).alias("categories")))


def decode_base64_runs(text: Column) -> Column:
    """Readable texts hidden in long base64 runs, in order."""
    runs = F.regexp_extract_all(text, F.lit(fv.BASE64_PATTERN), F.lit(0))

    def decode(run: Column) -> Column:
        data = F.rtrim(run, F.lit("="))
        # two data characters at the end may carry one pad or none
        padded = F.when(F.length(data) % 4 == 2, data).otherwise(run)
        return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    readable = F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]")
    return F.filter(F.transform(runs, decode),
                    lambda t: t.isNotNull() & (t != "") & ~F.rlike(t, readable))


def _holds_any(text: Column, pieces) -> Column:
    found = F.lit(False)
    for piece in pieces:
        found = found | F.contains(text, F.lit(piece))
    return found


def _marks(raw: Column) -> Column:
    """Signals of the raw characters: direction marks, blanks spliced into words."""
    return F.struct(
        _holds_any(raw, fv.BIDI).alias("bidi"),
        (_holds_any(raw, fv.INVISIBLE) & F.rlike(raw, F.lit(fv.ZERO_WIDTH_IN_WORD_PATTERN))).alias("spliced"))


def _score(marks: Column, masks: Column, signatures) -> Column:
    plain, leet = masks[0], masks[1]
    blob = F.get(F.filter(
        F.transform(F.slice(masks, 3, F.greatest(F.size(masks) - 2, F.lit(0))),
                    lambda m: mask_score(m, signatures)),
        lambda score: score > 0), F.lit(0))
    cats = mask_categories(plain, signatures)
    fresh = F.array_except(mask_categories(leet, signatures), cats)
    bidi, spliced = marks["bidi"], marks["spliced"]
    score = (mask_score(plain, signatures)
             + F.when(F.size(fresh) > 0, mask_score(leet, signatures)).otherwise(0.0)
             + F.when(blob.isNotNull(), F.greatest(blob, F.lit(1.0))).otherwise(0.0)
             + F.when(bidi, 0.5).otherwise(0.0)
             + F.when(spliced, 0.5).otherwise(0.0))
    reasons = F.concat(
        cats,
        F.transform(fresh, lambda c: F.concat(c, F.lit(" (leetspeak)"))),
        F.array_compact(F.array(
            F.when(blob.isNotNull(), F.lit("base64-encoded payload")),
            F.when(bidi, F.lit("bidirectional control characters")),
            F.when(spliced, F.lit("zero-width characters inside words")))))
    return F.struct(score.alias("score"), reasons.alias("reasons"), cats.alias("categories"))


def injection_score(text: Column, signatures=fv.SIGNATURES, scan_lines: bool = False) -> Column:
    """struct(score, reasons, categories) of a raw message text.

    ``scan_lines`` also scans with line breaks kept, so a heading inside a longer
    message can be seen.
    """
    compat = nfkc(text)
    # blanks never belong to a base64 run, so runs can be looked for before
    # blanks are collapsed; the second NFKC pass only sees decoded payloads
    folded = fold_letters(compat)
    hidden = F.when(F.rlike(folded, F.lit(_LONG_RUN)),
                    F.array_join(decode_base64_runs(folded), _BLOB_SEPARATOR))
    blobs = F.split(nfkc(hidden), _BLOB_SEPARATOR)

    def gated(letters: Column) -> Column:
        if signatures is not fv.SIGNATURES:
            return collapse_blanks(letters)
        # the leet fold keeps letters, so one test covers both scans
        return patterns.let(leet_fold(patterns.folded(letters)), lambda low: F.when(
            _holds_any(low, _WORDS) | F.rlike(low, F.lit(_LONE_DAN)), collapse_blanks(letters)))

    empty = F.array().cast("array<string>")

    def forms(x: Column) -> Column:
        # the plain text, its leet fold where different, then decoded payloads
        norm = x["norm"]
        decoded = F.transform(x["blobs"], lambda b: collapse_blanks(fold_letters(b)))
        lines = F.array(x["letters"]) if scan_lines else empty
        return F.concat(F.array(norm, F.nullif(leet_fold(norm), norm)), lines,
                        F.coalesce(decoded, empty))

    parts = [patterns.let(folded, gated).alias("norm"), blobs.alias("blobs")]
    texts = patterns.let(F.struct(*parts, *([folded.alias("letters")] if scan_lines else [])), forms)
    masks = F.transform(texts, lambda t: patterns.let(
        patterns.folded(t), lambda low: signature_mask(t, low, signatures)))
    if scan_lines:
        masks = patterns.let(masks, lambda m: F.concat(
            F.array(m[0].bitwiseOR(m[2]), m[1]), F.slice(m, 4, F.size(m))))
    return F.when(text.isNotNull(), patterns.let(
        F.struct(masks.alias("m"), _marks(text).alias("raw")),
        lambda x: patterns.let(x["m"], lambda m: _score(x["raw"], m, signatures))))


def block_reason(reasons: Column) -> Column:
    return F.concat(F.lit("Prompt injection attempt detected ("), F.array_join(reasons, ", "), F.lit(")"))
