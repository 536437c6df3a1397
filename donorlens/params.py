"""Parameters of the registered report runs (test data: gifts 1995-2001)."""

from __future__ import annotations

LEDGER_START = "1996-01-01"
LEDGER_END = "1997-12-31"
ONE_PARTNER = 5

CATEGORY_PERIOD = "YTD"
CATEGORY_AS_OF = "1998-12-31"

MARKETING_PERIOD = "CST"
MARKETING_START = "1996-01-01"
MARKETING_END = "1997-12-31"

LEGACY_START = "1996-01-01"
LEGACY_END = "1999-12-31"

RECURRING_START = "1998-10-01"
RECURRING_END = "1998-10-31"
RECURRING_HISTORY_START = "1996-04-01"

CERTIFICATE_AS_OF = "2001-06-30"
CERTIFICATE_PROFILE_SINCE = 2000  # last gift year of a profile to count
CERTIFICATE_HISTORY_MONTHS = 13

ORDERS_NEXT_AFTER = "2021-01-01"
ORDERS_ON_DATE = "2020-10-27"

PROJECT_TOTALS_PATTERN = "%00002%"
PROJECT_TOTALS_SINCE = "1997-01-01"
THANKYOU_PATTERN = "F-00001%"
PROVIDER_PATTERN = "mangopaysanpexp"
LOOKUP_PARTNER = 5
PROVIDER_OTHER_PATTERN = "mangopaysanpdonation"

DONOR_POSTCODES = ("1037", "1239", "1296", "1370", "1444", "1956", "2673")
DONOR_PROVINCES = ("Antwerpen", "Luik", "Namen")
DONOR_DESCRIPTIONS = ("mangopay sa np exp%", "mangopay sanp %", "%line%5")
DESCRIPTION_LEFT_OUT = "GIFT/2014/%"
MAIL_CODES = ("F-00000", "F-00001", "F-00003")
LOOKUP_DESCRIPTION = ("%koalect%",)
LOOKUP_DEPARTMENT = "%00000005%"
LOOKUP_DATES = ("1997-01-31", "1996-09-23", "1996-10-27")
LOOKUP_PROJECT = "blue%"
CERTIFICATE_ENTITY = "beheer b%"
CERTIFICATE_NOT_DONOR = ("customer#000000001", "%00003")
ORDERS_DUE_ON = "2020-10-15"
TRACE_NAMES = ("B-15-0", "B-15-40", "B-15-60", "B-15-100", "B-15-120")
TRACE_ACCOUNTS = (6, 8, 12, 13, 16, 20)

MONTHLY_ORDERS_NEXT_AFTER = "2019-01-01"
MONTHLY_ORDERS_AS_OF = "2022-01-01"
LATEST_INVOICES = 100

# stored ledger and profile: two loads that overlap; small tables need few buckets
STORE_LOADS = (("1996-01-01", "1997-03-15"), ("1997-02-01", "1997-12-31"))
STORE_BUCKETS = 2
STORE_HOT_ROWS = 2000
PROFILE_YEAR_LOADS = ((1990, 2012), (2010, 2035))
CERTIFICATE_PARTNERS = (1, 3, 5, 7, 11, 13, 101)
