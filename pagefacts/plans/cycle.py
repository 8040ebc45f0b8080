"""The scheduled cycle of all sites that are due, as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.functions import classify as K
from pagefacts.operators import changes as J
from pagefacts.operators import lookups as L
from pagefacts.operators import rollups as R
from pagefacts.operators.extract import extract
from pagefacts.plans.publish import export_events, export_others, exported_rows
from pagefacts.plans.refresh import format_extracted, page_rules
from pagefacts.session import cut_lineage
from pagefacts.sources.store import Store
from pagefacts.vocab import DEFAULT, Vocabulary


@dataclass(frozen=True)
class Cycle:
    """What a cycle leaves: the next store, the sites it was for, and their documents (dump, seedurl, s, part, json)."""

    store: Store
    sites: DataFrame
    documents: DataFrame


def _of_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    return rows.join(sites.select("seedurl"), "seedurl", "left_semi")


def refresh_some(
    store: Store, pages: DataFrame, captures: DataFrame, kg: DataFrame, as_of: str, vocab: Vocabulary = DEFAULT
) -> Store:
    """The next store after capturing some pages (webpage_id): statements of other pages do not take part.

    Rules run for the given pages only; names are looked up in the whole store.
    """
    ids = pages.select("webpage_id").distinct()
    page, tagged = page_rules(store)
    usable = K.flag_blocked(captures).filter("not blocked").select("url", "html")
    extracted = cut_lineage(extract(page.join(ids, "webpage_id", "left_semi"), tagged, usable).drop("trace"), "extracted")
    formatted = cut_lineage(format_extracted(store, extracted, kg, vocab), "formatted")
    mine = store.with_(statements=store.statements.join(ids, "webpage_id", "left_semi"))
    others = store.statements.join(ids, "webpage_id", "left_anti")
    refreshed = J.refresh(mine, formatted, as_of, vocab)
    return J.saved(store, cut_lineage(refreshed.unionByName(others.select(*refreshed.columns)), "refreshed"), as_of)


def scheduled_cycle(store: Store, captures: DataFrame, kg: DataFrame, as_of: str, vocab: Vocabulary = DEFAULT) -> Cycle:
    """For every site whose schedule asks for it (UTC), refresh the pages of coming events and the list pages,
    add the pages that lists name, export the site, and note ``as_of`` as its last refresh.

    Sites that are not due keep all they have. A page without a capture keeps its values, and its site counts as
    refreshed all the same, as a schedule asks again only after its days have passed.
    """
    due = cut_lineage(J.due_sites(store, as_of).select("id", "seedurl"), "due")
    work = J.refresh_worklist(store, "upcoming", as_of).unionByName(J.refresh_worklist(store, "lists", as_of))
    asked = cut_lineage(_of_sites(work, due).select("webpage_id", "url"), "asked")
    bodies = captures.join(asked.select("url").distinct(), "url", "left_semi")
    after = refresh_some(store, asked, bodies, kg, as_of, vocab)
    new = J.add_webpages(after, as_of).join(due.select(F.col("id").alias("website_id")), "website_id", "left_semi")
    columns = after.webpages.columns
    pages = cut_lineage(after.webpages.unionByName(new.select(*columns)), "pages")
    noted = due.select("id", F.lit(True).alias("_due"))
    sites = (
        store.websites.join(noted, "id", "left")
        .withColumn("last_refresh", F.when(F.col("_due"), R.as_time(as_of)).otherwise(F.col("last_refresh")))
        .select(*store.websites.columns)
    )
    after = after.with_(webpages=pages, websites=sites)
    flat = exported_rows(after)
    events = export_events(after, kg, _of_sites(R.publishable_events(after, flat=flat), due), vocab, flat)
    others = export_others(after, _of_sites(L.other_entities(after, flat=flat), due), vocab, flat)
    documents = events.withColumn("dump", F.lit("events")).unionByName(others.withColumn("dump", F.lit("others")))
    return Cycle(after, due, documents)
