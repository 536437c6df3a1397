"""Posting trace: from a reconciliation to its moves, invoices, invoice
lines, membership lines and analytic lines - the manual look-up chain used to
follow one payment, as one join chain over a set of reconciliations.

For named reconciliations the chain is followed key set by key set: the moves
are found first and restrict the scans of lines, invoices and analytic lines
(``only_keys``), the invoices those of their lines, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import KEY_LIMIT, left_join_spread_nulls, only_keys


def _reconciled_moves(t, reconcile_names=None) -> DataFrame:
    """(reconcile_name, move_id) of the reconciliations, or of the named ones."""
    rec = t.account_move_reconcile.select(F.col("id").alias("rec_id"), F.col("name").alias("reconcile_name"))
    if reconcile_names is not None:
        rec = rec.where(F.col("reconcile_name").isin(*reconcile_names))
    lines = t.account_move_line_reconcile.select("move_id", "reconcile_id")
    return rec.join(lines, F.col("reconcile_id") == F.col("rec_id"), "inner").select("reconcile_name", "move_id")


def _moves_and(t, reconcile_names, limit: int):
    """(reconciled moves, restriction of a table to them); without names the whole tables are traced."""
    moves = _reconciled_moves(t, reconcile_names)
    if reconcile_names is None:
        return moves, lambda table, key, keys: table
    return moves, lambda table, key, keys: only_keys(table, key, keys, limit)


def posting_lines(t, reconcile_names=None, key_limit: int = KEY_LIMIT) -> DataFrame:
    """The posting behind each reconciliation: its lines with move, partner and account."""
    reconciled, only = _moves_and(t, reconcile_names, key_limit)
    ids = reconciled.select("move_id")
    moves = only(t.account_move, "id", ids).select(F.col("id").alias("am_id"), F.col("name").alias("boeking"))
    lines = only(t.account_move_line, "move_id", ids).select(F.col("move_id").alias("line_move"), "account_id", "partner_id", "date", "debit", "credit")
    partners = t.res_partner.select(F.col("id").alias("p_id"), F.col("name").alias("naam"))
    accounts = t.account_account.select(
        F.col("id").alias("aa_id"), F.col("code").alias("grootboekrek"), F.col("name").alias("grootboekrek_naam"))
    # one reconciliation is a few moves: distinct, since it may list a move once per line
    found = (reconciled.distinct()
             .join(moves, F.col("move_id") == F.col("am_id"), "inner")
             .join(lines, F.col("move_id") == F.col("line_move"), "inner")
             .join(accounts, F.col("account_id") == F.col("aa_id"), "inner"))
    return left_join_spread_nulls(found, partners, "partner_id", "p_id").select(
        "reconcile_name", "move_id", "boeking", "partner_id", "naam", "grootboekrek", "grootboekrek_naam", "date", "debit", "credit")


def posting_analytic_lines(t, reconcile_names=None, account_ids=None, key_limit: int = KEY_LIMIT) -> DataFrame:
    """The analytic lines of each reconciliation's moves, optionally only
    those on the given analytic accounts, with the project they are booked on."""
    reconciled, only = _moves_and(t, reconcile_names, key_limit)
    analytic = only(t.account_analytic_line, "move_id", reconciled.select("move_id")).select(
        F.col("account_id").alias("al_account"), F.col("move_id").alias("al_move"))
    if account_ids is not None:
        analytic = analytic.where(F.col("al_account").isin(*account_ids))
    projects = t.account_analytic_account.select(
        F.col("id").alias("aaa_id"), F.col("code").alias("project_code"), F.col("name").alias("project"))
    found = (reconciled.distinct()
             .join(analytic, F.col("move_id") == F.col("al_move"), "inner")
             .join(projects, F.col("al_account") == F.col("aaa_id"), "left"))
    return found.select("reconcile_name", "move_id", F.col("al_account").alias("account_id"), "project_code", "project")


def posting_trace(t, reconcile_names=None, key_limit: int = KEY_LIMIT) -> DataFrame:
    reconciled, only = _moves_and(t, reconcile_names, key_limit)
    ids = reconciled.select("move_id")
    invoices = only(t.account_invoice, "move_id", ids).select(F.col("id").alias("invoice_id"), F.col("move_id").alias("inv_move_id"))
    inv_lines = only(t.account_invoice_line, "invoice_id", invoices.select("invoice_id")).select(
        F.col("id").alias("invoice_line_id"), F.col("invoice_id").alias("il_inv"))
    members = only(t.membership_membership_line, "account_invoice_line", inv_lines.select("invoice_line_id")).select(
        F.col("id").alias("membership_line_id"), F.col("account_invoice_line").alias("ml_line")
    )
    # analytic lines are counted per move before the join (one row per move)
    analytic = only(t.account_analytic_line, "move_id", ids).groupBy(F.col("move_id").alias("al_move")).agg(
        F.count(F.lit(1)).alias("analytic_lines")
    )
    chain = (
        reconciled
        .join(invoices, F.col("inv_move_id") == F.col("move_id"), "inner")
        .join(inv_lines, F.col("il_inv") == F.col("invoice_id"), "inner")
        .join(members, F.col("ml_line") == F.col("invoice_line_id"), "left")
        .join(analytic, F.col("al_move") == F.col("move_id"), "left")
    )
    return chain.select(
        "reconcile_name", "move_id", "invoice_id", "invoice_line_id", "membership_line_id",
        F.coalesce(F.col("analytic_lines"), F.lit(0)).cast("bigint").alias("analytic_lines"),
    )
