"""Names, versions and identifiers: forms of version references, checks of slugs and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "(0|[1-9][0-9]*)"
TRIPLE, DOUBLE, SINGLE = (rf"^v?{NUMBER}" + rf"\.{NUMBER}" * n for n in (2, 1, 0))
CHANNELS = ("main", "latest", "stable")
FLOATING = ("named_channel", "floating_major", "floating_minor")


def bare(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/tags/", "")


def ref_form(name: Column) -> Column:
    """named_channel, floating_major, floating_minor, exact or other.

    Build metadata (after the first +) is only allowed after one to three plain numbers, a
    pre-release (after -) only after three.
    """
    b = bare(name)
    core = F.substring_index(b, "+", 1)
    return (
        F.when(F.lower(b).isin(*CHANNELS), "named_channel")
        .when(F.contains(b, F.lit("+")) & core.rlike(TRIPLE + "$"), "exact")
        .when(F.contains(b, F.lit("+")) & core.rlike(DOUBLE + "$"), "floating_minor")
        .when(F.contains(b, F.lit("+")), "other")
        .when(b.rlike(TRIPLE + "-.+$"), "exact")
        .when(b.rlike(SINGLE + "$"), "floating_major")
        .when(b.rlike(DOUBLE + "$"), "floating_minor")
        .when(b.rlike(TRIPLE + "$"), "exact")
        .otherwise("other")
    )


def is_floating(form: Column) -> Column:
    return form.isin(*FLOATING)


def version_numbers(version: Column) -> Column:
    """Dotted parts as numbers, by their leading digits."""
    return F.transform(F.split(version, "[.]"), lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]*", 0).try_cast("bigint"), F.lit(0)))


def version_at_least(version: Column, minimum: Column) -> Column:
    """Whether a version is not before another, part by part; parts that only one of them has are 0 in the other."""
    a, b = version_numbers(version), version_numbers(minimum)
    filled = lambda x, y: F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.size(y) - F.size(x), F.lit(0))))
    return filled(a, b) >= filled(b, a)


def is_sha(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{40}$")


def is_hash_ref(value: Column) -> Column:
    return value.rlike("^sha256:[0-9a-f]{64}$")


def is_slug(value: Column) -> Column:
    return value.rlike("^[^/]+/[^/]+$")


def path_segment(slug: Column) -> Column:
    return F.replace(slug, F.lit("/"), F.lit("--"))


def uses_references(text: Column) -> Column:
    """Outside actions that a workflow text uses: array of (repo, path, rev), in line order.

    Lines are ``uses: owner/name[/path]@rev``, as list items or not, quoted or not; local paths,
    containers and comments don't count.
    """
    value = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?i)^\s*(-\s*)?uses:", "")), '^"+|"+$', "")), "^'+|'+$", ""))
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"(?i)^\s*(-\s*)?uses:"))
    outside = F.filter(F.transform(lines, value), lambda v: ~(v.startswith("./") | (v == ".") | v.startswith("docker://")) & v.rlike("^[^/]*/.*@[^@]+$"))

    def parsed(v: Column) -> Column:
        left, rev = F.regexp_extract(v, "^(.*)@[^@]+$", 1), F.regexp_extract(v, "@([^@]+)$", 1)
        parts = F.split(left, "/")
        path = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/"))
        return F.struct(F.concat_ws("/", parts[0], parts[1]).alias("repo"), path.alias("path"), rev.alias("rev"))

    return F.transform(outside, parsed)


def via(repo: Column, path: Column, commit: Column) -> Column:
    """repo[@path]@commit"""
    return F.concat_ws("@", repo, path, commit)
