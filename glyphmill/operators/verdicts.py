"""Ordered rules that decide what may be edited; the first that applies names the outcome.

Fixed values: the branches' names, the reasons' wordings and the strategies' names are part of the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _verdict(branch: str, editable: bool, substitution: bool = False, reason: str | Column | None = None) -> Column:
    said = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
    return F.struct(F.lit(branch).alias("branch_id"), F.lit(editable).alias("editable"), F.lit(substitution).alias("substitution"), said.alias("reason"))


def font(c=F.col) -> Column:
    """The verdict of a row of fonts: subtype decides before the symbolic flag does.

    Columns: subtype, symbolic, embedded, has_encoding, has_charproc, standard_14, cmap (ok, unreadable, none,
    only_31), n_codespace (widths found; null if none can be), descendant, gid_map_ok, gid_map_reason.
    """
    type0 = (
        F.when(c("descendant").isNull(), _verdict("NODESC", False, reason="Type0 with no /DescendantFonts"))
        .when(c("n_codespace").isNull(), _verdict("C-1", False, reason="CMap codespace not resolvable from the font dictionary"))
        .when(c("n_codespace") > 1, _verdict("C-6", False, reason="mixed-byte-width codespace ranges"))
        .when(~c("embedded"), _verdict("NOEMB", False, reason="Type0 descendant font not embedded"))
        .when(c("descendant") == "/CIDFontType0", _verdict("C-3b", True))
        .when((c("descendant") == "/CIDFontType2") & c("gid_map_ok"), _verdict("C-3a", True))
        .when(c("descendant") == "/CIDFontType2", _verdict("C-3a", False, reason=c("gid_map_reason")))
        .otherwise(_verdict("C-3", False, reason=F.concat(F.lit("unrecognised CIDFont /Subtype '"), c("descendant"), F.lit("'"))))
    )
    type3 = F.when(c("has_charproc"), _verdict("T3-a", True)).otherwise(_verdict("T3-a", False, reason="Type3 font with no /CharProcs"))
    bare = _verdict("NOEMB", False, reason="symbolic simple font, not embedded")
    truetype = (
        F.when(~c("symbolic"), _verdict("TT-a", True))
        .when(~c("embedded"), bare)
        .when(c("has_encoding"), _verdict("TT-c", False, reason="TrueType symbolic with /Encoding present"))
        .when(c("cmap") == "unreadable", _verdict("TT-f", False, reason="cmap subtable directory unreadable"))
        .when(c("cmap") == "none", _verdict("TT-e", False, reason="TrueType with no cmap table"))
        .when(c("cmap") == "only_31", _verdict("TT-d", False, reason="symbolic TrueType with only a (3,1) cmap"))
        .otherwise(_verdict("TT-b", True))
    )
    type1 = (
        F.when(~c("embedded") & c("symbolic"), bare)
        .when(~c("embedded"), F.when(c("standard_14"), _verdict("T1-c", True, True)).otherwise(_verdict("T1-d", True, True)))
        .when(c("symbolic") & c("has_encoding"), _verdict("T1-b", True))
        .otherwise(_verdict("T1-a", True))
    )
    return (
        F.when(c("subtype") == "/Type0", type0)
        .when(c("subtype") == "/Type3", type3)
        .when(c("subtype") == "/TrueType", truetype)
        .when(c("subtype").isin("/Type1", "/MMType1"), type1)
        .otherwise(_verdict("UNKNOWN", False, reason=F.concat(F.lit("unrecognised /Subtype '"), F.coalesce(c("subtype"), F.lit("")), F.lit("'"))))
    )


def glyph(font_editable: Column, font_reason: Column, unicode: Column) -> Column:
    """A glyph's refusal, or null: its font's, or that it has no character (null or empty)."""
    return F.when(~font_editable, font_reason).when(F.coalesce(unicode, F.lit("")) == "", "NOUNI")


def run(shared_pages: Column, branch_id: Column, font_editable: Column, font_reason: Column, substitution: Column, rtl: Column, glyph_reason: Column) -> Column:
    """(state, reason) of a run: a shared form, a Type3 font, the font's refusal, right-to-left text, a bad glyph; else editable.

    shared_pages: pages that share the first shared form on the run's path, or null.
    """
    reason = (
        F.when(shared_pages.isNotNull(), F.concat(F.lit("shared Form XObject, referenced by "), shared_pages.cast("string"), F.lit(" pages")))
        .when(branch_id == "T3-a", "Type3")
        .when(~font_editable, font_reason)
        .when(rtl, "right-to-left text")
        .otherwise(glyph_reason)
    )
    refused = shared_pages.isNotNull() | (branch_id == "T3-a") | ~font_editable | rtl | glyph_reason.isNotNull()
    state = F.when(refused, "not_editable").when(substitution, "editable_substitution").otherwise("editable_original")
    return F.struct(state.alias("state"), reason.alias("reason"))


def fit(original: Column, shaped: Column, space: Column, gaps: Column) -> Column:
    """How a replacement of the width `shaped` fits the width `original`: the first rung that absorbs the difference.

    gaps counts the spaces between words; condensing goes down to 90 per cent.
    """
    delta = shaped - original
    return (
        F.when((delta <= 0) | (F.abs(delta) <= space), "trailing_kern")
        .when((gaps > 0) & (F.abs(delta) <= gaps * space * 0.5), "inter_word_kern")
        .when(original * 100 >= shaped * 90, "tz")
        .otherwise("refused")
    )


def audit_status(c=F.col) -> Column:
    """What became of an audited file: columns opened, n_runs, n_candidates, planned_ok, applied, text_ok, pixels_ok."""
    return (
        F.when(~c("opened"), "unreadable").when(c("n_runs") == 0, "no_text").when(c("n_candidates") == 0, "no_candidates")
        .when(~c("planned_ok"), "refused").when(~c("applied"), "apply_failed").when(c("text_ok").isNull(), "unverifiable")
        .when(~c("text_ok"), "wrong_text").when(~c("pixels_ok"), "pixels_changed").otherwise("ok")
    )
