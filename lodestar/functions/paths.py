"""Paths: order of discovery, suffixes, display, containment."""

from __future__ import annotations

import ntpath
import sys
from functools import cache
from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types that count as images (fixed values).
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """What full case folding makes of single characters: those that become one other, what they become, and those that become several."""
    folded = {c: c.casefold() for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]) if c.casefold() != c}
    single = {c: f for c, f in folded.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folded.items() if len(f) > 1}


def fold(text: Column) -> Column:
    """text under full Unicode case folding (sharp s becomes ss, final sigma sigma), which lower case isn't; all in Catalyst.

    ASCII is put into lower case and that is all; of other texts single characters are
    mapped, and only those with characters that become several are taken apart.
    """
    before, after, several = _folds()
    kinds = "".join(several)
    ascii_ = F.translate(text, ascii_uppercase, ascii_lowercase)
    single = F.translate(ascii_, before, after)
    many = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    apart = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.element_at(many, c), c)), "")
    return F.when(text.rlike(r"^\p{ASCII}*$"), ascii_).when(single.rlike(f"[{kinds}]"), apart).otherwise(single)


def walk_key(path: Column) -> Column:
    """Sorts relative paths as a walk meets them: in each directory the files first, then its directories, by (case-folded name, name)."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.struct((i < F.size(parts) - 1).cast("int").alias("is_dir"), fold(x).alias("fold"), x.alias("name")))


def suffix(path: Column) -> Column:
    """The last part's suffix in lower case, or ''; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1))


def display(relative_path: Column, source_path: Column, root: str | None) -> Column:
    """source_path, or the relative path below root in Windows notation."""
    if root is None:
        return source_path
    drive, rest = ntpath.splitdrive(root.replace("/", "\\"))
    if drive and not rest:  # a drive alone is relative to its current directory: no separator follows
        return F.concat(F.lit(drive), F.replace(relative_path, F.lit("/"), F.lit("\\")))
    base = (drive + rest).rstrip("\\")
    return F.concat(F.lit(base + "\\"), F.replace(relative_path, F.lit("/"), F.lit("\\")))


def is_within(path: str | Path, directory: str | Path) -> bool:
    """Whether path, resolved, is directory or below it."""
    own, top = Path(path).resolve(), Path(directory).resolve()
    return own == top or top in own.parents


def require_outside(evidence: str | Path, *artifacts: str | Path | None) -> None:
    """Fail if an artifact would be written into the evidence."""
    for artifact in artifacts:
        if artifact is not None and is_within(artifact, evidence):
            raise ValueError(f"artifact must be outside evidence: {artifact}")


def require_disjoint(evidence: str | Path, *folders: str | Path) -> None:
    """Fail if a folder lies in the evidence or the evidence in it."""
    for folder in folders:
        if is_within(folder, evidence) or is_within(evidence, folder):
            raise ValueError(f"folder and evidence must not overlap: {folder}")
