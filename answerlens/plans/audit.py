"""Page audit: every check over every captured page, then the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerlens.operators import audit as A


def audit(
    captures: DataFrame, robots: DataFrame, bots: DataFrame, bot_products: DataFrame,
    sitemaps: DataFrame | None = None, llms_files: DataFrame | None = None,
    bot_captures: DataFrame | None = None, crawl_index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(check results per page, scores per page).  Site-level checks count for each page of the site."""
    pages = captures.filter(F.col("variant") == "desktop").select(*A.PAGE)
    page_checks = [A.page_checks(captures, bots)]
    if bot_captures is not None:
        page_checks.append(A.check_all_bots(captures, bot_captures, bots, bot_products))
    site_checks = [A.check_robots(robots, bots, bot_products)]
    if sitemaps is not None:
        site_checks.append(A.check_sitemap(sitemaps))
    if llms_files is not None:
        site_checks.append(A.check_llms_txt(llms_files))
    if crawl_index is not None:
        site_checks.append(A.check_crawl_presence(pages.select("site"), crawl_index))
    per_site = site_checks[0]
    for extra in site_checks[1:]:
        per_site = per_site.unionByName(extra)
    results = pages.join(per_site, "site").select(*page_checks[0].columns)
    for extra in page_checks:
        results = results.unionByName(extra)
    return results, A.audit_score(results)
