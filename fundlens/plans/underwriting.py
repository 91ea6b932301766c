"""The underwriting chain from raw extractions to submission summaries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import classify, positions as P, statements as S, underwriting as U
from ..operators.running import nest_pages
from ..session import Staging
from ..sources.calendar import Calendar
from ..sources.rules import default_rules


class Underwriting:
    """Lazily built results over extractions, the document ledger and the rules.

    ``staged`` writes the results that many later steps share (calculated
    statements, resolved and classified transactions, payments with their
    positions) to the shared folder instead of recomputing them.
    """

    def __init__(self, extractions: DataFrame, ledger: DataFrame, rules: DataFrame | None = None,
                 calendar: Calendar | None = None, staged: bool = True):
        self.spark = extractions.sparkSession
        self.extractions = extractions
        self.ledger = ledger
        self.rules = rules if rules is not None else default_rules(self.spark)
        self.calendar = calendar or Calendar()
        self._stage = Staging(self.spark) if staged else (lambda df, name: df)

    def discard(self) -> None:
        """Deletes the staged tables once the results have been written."""
        if isinstance(self._stage, Staging):
            self._stage.discard()

    @cached_property
    def canonical(self) -> DataFrame:
        return S.canonicalize_extractions(self.extractions)

    @cached_property
    def calculated(self) -> DataFrame:
        """Balanced statements: the one shuffle of whole statements ends here."""
        return self._stage(S.with_running_balances(S.calculate_statements(self.canonical)), "calculated")

    @cached_property
    def transactions(self) -> DataFrame:
        return S.statement_transactions(self.calculated)

    @cached_property
    def current(self) -> DataFrame:
        return self._stage(S.current_documents(self.ledger), "current")

    @cached_property
    def ordinals(self) -> DataFrame:
        return self._stage(self.calendar.ordinals(self.spark), "calendar")

    @cached_property
    def resolved(self) -> DataFrame:
        return self._stage(classify.resolve_matches(classify.match_rules(self.transactions, self.rules)), "resolved")

    @cached_property
    def pairs(self) -> DataFrame:
        return classify.reversal_pairs(self.resolved, self.current, self.ordinals)

    @cached_property
    def classified(self) -> DataFrame:
        return self._stage(classify.attach_pairs(self.resolved, self.pairs), "classified")

    @cached_property
    def periods(self) -> DataFrame:
        return self._stage(P.account_periods(self.calculated, self.current), "periods")

    @cached_property
    def coverage(self) -> DataFrame:
        return P.account_coverage(self.periods)

    @cached_property
    def events(self) -> DataFrame:
        return self._stage(P.payment_events(self.classified, self.periods), "events")

    @cached_property
    def epochs(self) -> DataFrame:
        return self._stage(P.funding_epochs(self.events), "epochs")

    @cached_property
    def openings(self) -> DataFrame:
        return self._stage(P.stream_openings(P.epoch_payments(self.epochs)), "openings")

    @cached_property
    def streams(self) -> DataFrame:
        return self._stage(P.amount_streams(self.openings), "streams")

    @cached_property
    def payments(self) -> DataFrame:
        return self._stage(P.with_consistency(self.streams), "payments")

    @cached_property
    def payment_days(self) -> DataFrame:
        return self._stage(P.payment_days(self.payments, self.coverage, self.ordinals), "payment_days")

    @cached_property
    def graded_positions(self) -> DataFrame:
        totals = P.position_totals(self.payments)
        cadenced = P.cadences(totals, self.payment_days, self.coverage, self.ordinals, self.calendar)
        return self._stage(P.position_confidence(cadenced), "positions")

    @cached_property
    def schedule(self) -> DataFrame:
        expected = P.expected_schedule(self.graded_positions, self.periods, self.ordinals, self.calendar)
        return self._stage(P.match_schedule(expected, self.payment_days), "schedule")

    @cached_property
    def statuses(self) -> DataFrame:
        return P.position_status(self.graded_positions, self.schedule)

    @cached_property
    def positions(self) -> DataFrame:
        return self._stage(P.mca_positions(self.statuses, self.payments, self.schedule), "mca_positions")

    @cached_property
    def statement_summary(self) -> DataFrame:
        return self._stage(
            U.statement_underwriting_summary(self.calculated, self.classified, self.positions, self.calendar),
            "statement_summary",
        )

    @cached_property
    def submission_documents(self) -> DataFrame:
        return self._stage(
            U.submission_documents(self.current, self.calculated, self.statement_summary),
            "submission_documents",
        )

    @cached_property
    def submission_summary(self) -> DataFrame:
        return U.submission_underwriting_summary(self.submission_documents, self.positions)

    @cached_property
    def submission_rows(self) -> DataFrame:
        """One row per statement of a submission, received or not; ``document_index`` is their order."""
        return self.submission_documents.drop("payload_conflict", "binding_conflict")

    @cached_property
    def submission_statements(self) -> DataFrame:
        """Ordered statements per submission, nested in bounded pages; ``submission_rows`` has them as rows."""
        fields = [c for c in U.SUBMISSION_DOCUMENT if c not in ("entry_id", "payload_conflict", "binding_conflict")]
        return nest_pages(
            self.submission_documents, "entry_id", ["document_index", "document_id", "file_id"], fields, "statements"
        )

    @cached_property
    def reconciliation_summary(self) -> DataFrame:
        return S.submission_statement_summary(S.submission_statement_documents(self.current, self.calculated))
