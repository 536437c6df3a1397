"""Declared schemas of the ERP / CRM tables the reports read.

Column lists are the columns the reports use; types follow the accounting
system (ids as BIGINT except small lookup ids, money as DECIMAL(15,2)).
Each schema is a Spark DDL string so it can be handed to
``spark.read.schema`` directly.
"""

from __future__ import annotations

MONEY = "DECIMAL(15,2)"

SCHEMAS: dict[str, str] = {
    "account_move": "id BIGINT, name STRING",
    "account_move_line": (
        f"move_id BIGINT, account_id INT, partner_id BIGINT, company_id INT, date DATE, "
        f"debit {MONEY}, credit {MONEY}, name STRING, ref STRING, "
        "analytic_dimension_1_id BIGINT, analytic_dimension_2_id BIGINT, analytic_dimension_3_id BIGINT"
    ),
    "account_account": "id INT, code STRING, name STRING",
    "account_analytic_account": "id BIGINT, code STRING, name STRING",
    "res_company": "id INT, name STRING",
    "res_partner": (
        "id BIGINT, name STRING, first_name STRING, last_name STRING, active BOOLEAN, "
        "deceased BOOLEAN, active_partner_id BIGINT, membership_state STRING, "
        "membership_state_b STRING, membership_nbr STRING, membership_cancel DATE, "
        "membership_cancel_b DATE, street STRING, street_id BIGINT, street_nbr STRING, "
        "street_bus STRING, zip STRING, zip_id BIGINT, city STRING, postbus_nbr STRING, "
        "crab_used BOOLEAN, country_id INT, state_id INT, department_id BIGINT, "
        "department_choice_id BIGINT, relation_partner_id BIGINT, title INT, gender STRING, "
        "birthday DATE, national_id_nbr STRING, address_state_id INT, opt_out BOOLEAN, "
        "opt_out_letter BOOLEAN, iets_te_verbergen BOOLEAN, email STRING, email_work STRING, "
        "mobile STRING, phone STRING, corporation_type_id INT, organisation_type_id INT, "
        "tax_certificate BOOLEAN, company_registration_number STRING"
    ),
    "res_partner_payment_history": (
        f"partner_id BIGINT, date DATE, amount {MONEY}, description STRING, "
        "project_nbr STRING, cost_center STRING"
    ),
    "account_bank_statement": "id INT, name STRING, state STRING",
    "account_bank_statement_line": (
        f"statement_id INT, account_id INT, partner_id BIGINT, date DATE, amount {MONEY}, "
        "name STRING, analytic_dimension_1_id BIGINT, analytic_dimension_2_id BIGINT, "
        "analytic_dimension_3_id BIGINT"
    ),
    "donation_partner_account": (
        f"id BIGINT, partner_id BIGINT, analytic_account_id BIGINT, interval_type STRING, "
        f"interval_number INT, donation_amount {MONEY}, next_invoice_date DATE, "
        "donation_start DATE, last_invoice_date DATE, donation_cancel DATE"
    ),
    "donation_donation_line": (
        f"partner_id BIGINT, amount_total {MONEY}, date_invoice DATE, invoice_id BIGINT"
    ),
    "res_partner_bank": "id BIGINT, partner_id BIGINT, bank_bic STRING, acc_number STRING",
    "sdd_mandate": "id BIGINT, partner_bank_id BIGINT, state STRING",
    "res_country": "id INT, name STRING",
    "res_country_state": "id INT, name STRING",
    "res_country_city": "id BIGINT, name STRING, zip STRING",
    "res_country_city_street": "id BIGINT, name STRING",
    "res_partner_title": "id INT, shortcut STRING",
    "res_partner_corporation_type": "id INT, name STRING",
    "dwh_partners": (
        "partner_id BIGINT, vrijwilliger BOOLEAN, bestuurder BOOLEAN, "
        "conservator BOOLEAN, aankoper BOOLEAN"
    ),
    "website_users": "partner_id BIGINT",
    "suppression_list": "emailaddress STRING",
    "newsletter": "partner_id BIGINT",
    # posting trace (reconciliation -> invoice -> membership -> analytic line)
    "account_move_reconcile": "id BIGINT, name STRING",
    "account_move_line_reconcile": "id BIGINT, move_id BIGINT, reconcile_id BIGINT",
    "account_invoice": "id BIGINT, move_id BIGINT",
    "account_invoice_line": "id BIGINT, invoice_id BIGINT",
    "membership_membership_line": "id BIGINT, account_invoice_line BIGINT",
    "account_analytic_line": "account_id BIGINT, move_id BIGINT",
}

# Sink written by the marketing-income extract: one audit row per call.
MASTER_JOBS = "id BIGINT, datum TIMESTAMP_NTZ, sproc_id INT"


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a declared table, in declared order."""
    out = []
    depth = 0
    field = ""
    for ch in SCHEMAS[table] + ",":
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            name, typ = field.strip().split(" ", 1)
            out.append((name, typ.strip()))
            field = ""
        else:
            field += ch
    return out
