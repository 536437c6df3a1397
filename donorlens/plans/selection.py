"""Optional conditions of the donor, mailing and look-up lists.

A ``Selection`` holds the conditions an analyst adds to a list; what is unset
does not apply.  Conditions on the gift reach the facts before they are
folded, conditions on the donor apply to the partner attributes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R


def _all(conditions: Iterator[Column]) -> Column | None:
    out = None
    for condition in conditions:
        out = condition if out is None else out & condition
    return out


def _any_like(text: Column, patterns: tuple[str, ...]) -> Column:
    out = text.like(patterns[0])
    for pattern in patterns[1:]:
        out = out | text.like(pattern)
    return out


@dataclass(frozen=True)
class Selection:
    # the gift
    code_pattern: str | None = None  # LIKE pattern of the project code
    codes: tuple[str, ...] = ()  # exact project codes
    project_pattern: str | None = None  # LIKE pattern of the project name
    description_like: tuple[str, ...] = ()  # any of these patterns, lower-cased text
    description_not_like: str | None = None  # a gift without description is left out, too
    account: str | None = None
    dates: tuple[str, ...] = ()
    source: str | None = None
    # the donor
    postcodes: tuple[str, ...] = ()
    provinces: tuple[str, ...] = ()
    department_like: str | None = None  # lower-cased department
    with_email: bool | None = None
    accepts_email: bool = False
    accepts_post: bool = False

    def _of_gift(self) -> Iterator[Column]:
        if self.code_pattern is not None:
            yield F.col("project_code").like(self.code_pattern)
        if self.codes:
            yield F.col("project_code").isin(*self.codes)
        if self.project_pattern is not None:
            yield F.col("project").like(self.project_pattern)
        if self.description_like:
            yield _any_like(F.lower("description"), self.description_like)
        if self.description_not_like is not None:
            yield ~F.col("description").like(self.description_not_like)
        if self.account is not None:
            yield F.col("grootboekrek") == self.account
        if self.dates:
            yield F.col("date").isin(*[F.lit(d).cast("date") for d in self.dates])
        if self.source is not None:
            yield F.col("bron") == self.source

    def _of_donor(self) -> Iterator[Column]:
        if self.postcodes:
            yield F.col("postcode").isin(*self.postcodes)
        if self.provinces:
            yield F.col("provincie").isin(*self.provinces)
        if self.department_like is not None:
            yield F.lower("afdeling").like(self.department_like)
        if self.with_email is not None:
            has = F.coalesce(F.col("email"), F.lit("__")).like("%@%")
            yield has if self.with_email else ~has
        if self.accepts_email:
            yield F.col("email_ontvangen") == R.YES
        if self.accepts_post:
            yield R.contactable_by_post()

    def gift(self) -> Column | None:
        return _all(self._of_gift())

    def donor(self, *more: Column) -> Column | None:
        """The donor's conditions and ``more``."""
        return _all(iter([*more, *self._of_donor()]))


#: Columns that the donor conditions read.
DONOR_COLUMNS = ("postcode", "provincie", "afdeling", "email", "email_ontvangen", "overleden", "adres_status",
                 "post_ontvangen", "nooit_contacteren")
EVERYTHING = Selection()
