import pathlib

from fundlens.plans.underwriting import Underwriting

from statement_fixture import extractions, ledger


def test_staged_tables_go_to_the_configured_folder_and_can_be_discarded(spark, tmp_path):
    before = spark.conf.get("spark.fundlens.staging", None)
    spark.conf.set("spark.fundlens.staging", str(tmp_path))
    try:
        run = Underwriting(extractions(spark), ledger(spark))
        assert run.classified.count() > 30
        folder = pathlib.Path(run._stage.folder)
        assert folder.parent.parent == tmp_path and {"calculated", "resolved", "classified"} <= {p.name for p in folder.iterdir()}
        # Digests in hex take half the room.
        assert all(".zstd." in f.name for f in (folder / "classified").glob("*.parquet"))
        run.discard()
        assert not folder.exists()
    finally:
        if before is None:
            spark.conf.unset("spark.fundlens.staging")
        else:
            spark.conf.set("spark.fundlens.staging", before)


def test_results_do_not_depend_on_staging(spark):
    lazy = Underwriting(extractions(spark), ledger(spark), staged=False)
    eager = Underwriting(extractions(spark), ledger(spark))
    columns = ["transaction_id", "classification", "paired_reversal_transaction_id"]
    assert sorted(map(str, lazy.classified.select(*columns).collect())) == sorted(map(str, eager.classified.select(*columns).collect()))


def test_without_a_shared_folder_results_are_cached(spark):
    run = Underwriting(extractions(spark), ledger(spark))
    run._stage.folder = None
    assert run.resolved.count() == run.classified.count()
    assert run.resolved.is_cached and len(run._stage.cached) >= 3
    run.discard()
    assert not run.resolved.is_cached
