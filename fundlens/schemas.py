"""Declared schemas of the base tables and messages, as DDL text."""

from __future__ import annotations

MONEY = "decimal(18,2)"
EXACT = "decimal(38,9)"

TRANSACTION = f"struct<date: date, description: string, amount: {MONEY}>"
SUMMARY = (
    "struct<account_number: string, bank_name: string, company: string, "
    f"start_balance: {MONEY}, end_balance: {MONEY}, "
    "statement_start_date: date, statement_end_date: date, "
    f"total_credits: {MONEY}, total_debits: {MONEY}>"
)
STATEMENT = f"struct<summary: {SUMMARY}, transactions: array<{TRANSACTION}>>"


EXTRACTIONS = (
    "entry_id string not null, document_id string not null, document_index bigint not null, "
    f"file_id string not null, extracted_at timestamp not null, statement {STATEMENT}"
)

# The keys a posted extraction must carry, null or not.
SUMMARY_KEYS = [
    "account_number", "bank_name", "company", "start_balance", "end_balance",
    "statement_start_date", "statement_end_date", "total_credits", "total_debits",
]
TRANSACTION_KEYS = ["date", "description", "amount"]

LEDGER = (
    "document_id string, entry_id string, submitted_at timestamp, document_type string, "
    "document_index bigint, gcs_uri string, gcs_generation string, source_content_type string, "
    "source_size_bytes bigint, source_sha256 string, file_id string, vector_store_id string, "
    "vector_store_file_id string, ingestion_status string, openai_status string, "
    "attempt_count bigint, source_event_id string, error_code string, created_at timestamp, "
    "updated_at timestamp, completed_at timestamp, extraction_provider string, "
    "provider_file_id string, provider_job_id string, provider_event_id string, "
    "provider_status string, extraction_completed_at timestamp"
)

RULES = (
    "analysis_version bigint, rule_id string, priority bigint, active boolean, "
    "match_type string, match_value string, direction string, classification string, "
    "confidence string, canonical_counterparty string"
)

CALENDAR = (
    "calendar_date date, is_business_day boolean, is_weekend boolean, "
    "is_federal_holiday boolean, holiday_name string"
)

SUBMISSIONS = (
    "entry_id string, submitted_at timestamp, app_param string, utm_source string, "
    "utm_medium string, utm_campaign string, utm_term string, utm_content string, "
    "referrer string, ip_address string, user_agent string, contact_name string, "
    "contact_email string, contact_phone string, business_legal_name string, dba string, "
    "business_physical_street string, business_physical_city string, "
    "business_physical_state string, business_physical_zip string, industry string, "
    "industry_other string, state_of_incorporation string, business_started_month bigint, "
    "business_started_year bigint, federal_tax_id string, business_entity_type string, "
    f"gross_annual_sales_bucket string, requested_funding_amount {EXACT}, "
    "avg_monthly_deposits string, total_mca_debits string, avg_balance string, "
    "avg_negative_balance_days string, open_mca string, owner_full_name string, "
    "owner_ownership_percentage bigint, owner_ssn string, owner_dob date, "
    "owner_address_street string, owner_address_city string, owner_address_state string, "
    "owner_address_zip string, bank_statement_gcs_keys array<string>, pdf_gcs_key string, "
    "gcs_folder string, signature_captured boolean, terms_accepted boolean, "
    "raw_payload_json string, pdf_layout_version string, pdf_source_generation string, "
    "pdf_source_sha256 string, extraction_provider string, "
    "extraction_provider_locked_at timestamp"
)

_ADDRESS = "struct<street: string, city: string, state: string, zip: string>"
PAYLOAD = (
    "appParam string, "
    "utm struct<utm_source: string, utm_medium: string, utm_campaign: string, "
    "utm_term: string, utm_content: string, referrer: string>, "
    "underwriting struct<avg_monthly_deposits: string, total_mca_debits: string, "
    "avg_balance: string, avg_negative_balance_days: string, open_mca: string>, "
    "formData struct<contactName: string, contactEmail: string, contactPhone: string, "
    "businessLegalName: string, dba: string, "
    f"physicalAddress: {_ADDRESS}, industry: string, industryOther: string, "
    "stateOfIncorporation: string, businessStartedMonth: string, businessStartedYear: string, "
    "federalTaxId: string, businessEntityType: string, grossAnnualSalesBucket: string, "
    "requestedFundingAmount: string, "
    "owner: struct<fullName: string, ownershipPercentage: string, ssn: string, "
    f"dateOfBirth: string, address: {_ADDRESS}>, "
    "signature: string, termsAccepted: string>"
)

READY_EVENT = (
    "event_type string, schema_version bigint, analysis_version bigint, event_key string, "
    "entry_id string, status string, expected_document_count bigint, "
    "extracted_document_count bigint"
)
PDF_READY_EVENT = (
    "event_type string, schema_version bigint, analysis_version bigint, event_key string, "
    "entry_id string, status string, summary_fingerprint string, source_generation string, "
    "final_generation string, final_pdf_sha256 string"
)
