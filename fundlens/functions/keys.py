"""Deterministic identifiers, all lower-case hex SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMPTY_TEXT_DIGEST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def digest(*parts: Column | str, separator: str = "|") -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(separator, *columns), 256)


def json_digest(value: Column) -> Column:
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def transaction_id(file_id: Column, index: Column) -> Column:
    return digest(file_id, F.lpad(index.cast("string"), 20, "0"), separator=":")


def document_id(entry_id: Column, uri: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(digest(entry_id, uri, separator="\n"), 1, 32))


def account_digest(entry_id: Column, bank: Column, account: Column) -> Column:
    return digest("ENTRY", entry_id, "ACCOUNT", bank, account)


def inferred_account_digest(entry_id: Column, bank: Column, company: Column, chain: Column) -> Column:
    return digest("ENTRY", entry_id, "INFERRED", bank, company, chain)


def document_digest(entry_id: Column, document: Column) -> Column:
    return digest("DOCUMENT", entry_id, document)


def position_digest(account: Column, base: Column, epoch: Column, stream: Column) -> Column:
    return digest(account, base, epoch, stream)


def ready_event_key(entry_id: Column) -> Column:
    return F.concat(F.lit("bank_statement_underwriting:"), entry_id, F.lit(":v1"))


def pdf_event_key(entry_id: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("application_pdf:"), entry_id, F.lit(":v1:"), fingerprint)
