import tempfile

from mercato.plans import reports
from mercato.sources import read_star, write_star


def test_materialised_star_gives_same_results_and_pushes_filters(spark, star):
    path = tempfile.mkdtemp(prefix="mercato-star-", dir="/tmp")
    write_star(star, path)
    stored = read_star(spark, path)
    for name, df in star.as_dict().items():
        assert stored.as_dict()[name].schema == df.schema or [f.name for f in stored.as_dict()[name].schema] == df.columns
        assert stored.as_dict()[name].count() == df.count()

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(reports.top_products_by_category(stored)) == rows(reports.top_products_by_category(star))
    assert rows(reports.employee_ranking(stored)) == rows(reports.employee_ranking(star))
    r6 = reports.employee_product_summary(stored, 8)
    assert rows(r6) == rows(reports.employee_product_summary(star, 8))
    plan = r6._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(SalesPersonID,8)" in plan  # the seller filter reaches the sales scan
