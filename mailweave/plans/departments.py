"""Q4-Q6: three generations of department contacts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators import association as A
from ..operators import dedup
from ..operators import departments as DP
from ..operators import extract as X
from ..operators import html as H
from ..operators import merge as M
from ..operators import report
from ..operators import staff
from ..operators import walk as W
from ..session import cut_lineage
from ..siteprofile import SiteProfile


def _usable(pages: DataFrame) -> DataFrame:
    return X.usable_pages(pages).select("page_id", "url", "html")


def _read(pages: DataFrame, urls: DataFrame, parts=("nodes", "chunks", "clean"), column: str = "url", fields=None, **facts: Column) -> DataFrame:
    """Parse the pages among ``urls`` in one scan and write down what is wanted of them: ``page_id, url, _error, …facts``.

    The look-up goes below the Python step, where the optimizer cannot move it. HTML and DOM stay behind; of a DOM entry's
    fields those leave the parser that ``fields`` names.
    """
    doc = H.dom(X.pages_among(pages, urls, column), parts=parts, fields=fields)
    return cut_lineage(doc.select("page_id", "url", "_error", *[fact.alias(name) for name, fact in facts.items()]))


def _failed(*read: DataFrame) -> DataFrame:
    return H.parse_errors(reduce(DataFrame.unionByName, [r.select("url", "_error") for r in read]))


def _links(read: DataFrame, *keys: str) -> DataFrame:
    return read.select(*keys, F.inline("links"))


def _host_read(pages: DataFrame, starts: DataFrame, hits: Column) -> DataFrame:
    """Links and contacts of the pages on the hosts where walks start; a walk never leaves its host.

    Each page is parsed once for both; contacts of pages that the walk does not reach are left aside later.
    """
    hosts = starts.select(u.netloc(F.col("web")).alias("_host"))
    pages = pages.withColumn("_host", u.netloc(F.col("url")))
    return _read(pages, hosts, column="_host", fields=(*H.LINK_FIELDS, *A.CONTACT_FIELDS), links=H.anchor_structs(""), hits=hits)


@dataclass
class StructureRun:
    contacts: DataFrame  # nombre, correo, departamento, sorted by address
    departments: DataFrame
    failed: DataFrame  # pages that could not be parsed, by reason


def contacts_by_structure(pages: DataFrame, list_urls: DataFrame, directory_urls: DataFrame | None, site: SiteProfile) -> StructureRun:
    """Q4 by page layout, in three scans: lists, then department and guessed pages, then staff and directory pages."""
    pages = _usable(pages)
    lists = _read(pages, list_urls, ("nodes", "clean"), fields=H.LINK_FIELDS, links=H.anchor_structs(" "))
    depts = cut_lineage(DP.keyword_links(_links(lists, "page_id"), site))
    ranked = depts.select("dept_url", "dept_name", F.struct("page_id", "pos").alias("dept_no"))
    guessed = DP.guessed_pages(depts, site).select(F.col("staff_url").alias("url"))
    second = _read(
        pages, depts.select(F.col("dept_url").alias("url")).unionByName(guessed), links=H.anchor_structs(" "), relevant=DP.mentions_contacts(site)
    )
    targets = DP.staff_pages_of(depts, _links(second, "url"), second.filter("relevant"), site).join(ranked.select("dept_url", "dept_no"), "dept_url")
    targets = cut_lineage(targets)
    wanted = targets.select(F.col("staff_url").alias("url"))
    if directory_urls is not None:
        wanted = wanted.unionByName(directory_urls.select("url"))
    doc = H.dom(X.pages_among(pages, wanted))
    third = cut_lineage(staff.page_hits(doc, ("page_id", "url", "_error")))
    found = staff.first_hits(third, ("url",))
    rows = targets.join(found, targets["staff_url"] == found["url"]).select(
        "nombre", "correo", F.col("dept_name").alias("departamento"), "dept_no", "staff_url", "branch", "idx"
    )
    best = dedup.first_named_per_email(rows, order=("dept_no", "staff_url", "branch", "idx")).select("nombre", "correo", "departamento")
    if directory_urls is not None:
        listed = third.join(directory_urls.select("url").distinct(), "url", "left_semi")
        best = M.add_unseen(best, _directory_rows(staff.first_hits(listed, ("page_id", "url")), site))
    return StructureRun(best.orderBy("correo"), depts, _failed(lists, second, third))


def directory_contacts(directory_doc: DataFrame, site: SiteProfile) -> DataFrame:
    """Contacts of the general directory under one label."""
    return _directory_rows(staff.page_contacts(directory_doc, ("page_id", "url")), site)


def _directory_rows(rows: DataFrame, site: SiteProfile) -> DataFrame:
    first = dedup.first_per_key(rows, "correo", ["page_id", "branch", "idx"])
    return first.select("nombre", "correo", F.lit(site.directory_label).alias("departamento"))


@dataclass
class DepartmentRun:
    contacts: DataFrame  # departamento, profesor, email in arrival order
    departments: DataFrame
    visited: DataFrame
    failed: DataFrame  # pages that could not be parsed, by reason


def _sites(pages: DataFrame, depts: DataFrame, site: SiteProfile) -> tuple[DataFrame, DataFrame]:
    """Departments with mailbox and web address, and the pages read for them; written once, as the walk and the result both read them."""
    depts = cut_lineage(depts)
    mail = DP.card_mail(False, site.email_domains, site.strict)
    cards = _read(pages, depts.select(F.col("dept_url").alias("url")), mail=mail, web=DP.card_web(site))
    named = cards.select(F.col("url").alias("dept_url"), "mail", "web")
    return cut_lineage(depts.join(named, "dept_url", "left")), cards


def contacts_by_walk(pages: DataFrame, list_urls: DataFrame, site: SiteProfile, max_pages: int | None = 40) -> DepartmentRun:
    """Q5: every mailto link and every new text address of each department's web, mailboxes first."""
    pages = _usable(pages)
    lists = _read(pages, list_urls, ("nodes", "clean"), fields=H.LINK_FIELDS, links=H.anchor_structs(""))
    depts = DP.marker_links(_links(lists, "page_id"), site)
    # the id names the department; the second-last segment only where there is no id
    label = F.coalesce(u.department_id(F.col("dept_url"), site.department_marker), u.second_last_segment(F.col("dept_url")))
    depts, cards = _sites(pages, depts.withColumn("departamento", label), site)
    facts = _host_read(pages, depts, A.climbed_hits())
    visited = W.walk_hosts(W.co_locate(W.links_of(_links(facts, "url"))), depts, max_pages=max_pages)
    trail = visited.select("walk", "url", "level", "trail")
    rows = trail.join(H.rows_of(facts, ("url",), F.col("hits"), "email"), "url")
    rows = rows.select(F.col("walk").alias("dept_url"), F.struct("level", "trail").alias("page_ord"), "branch", "idx", "profesor", "email")
    personal = A.drop_known_text_emails(rows, "dept_url", ["page_ord", "branch", "idx"]).join(depts.select("dept_url", "departamento"), "dept_url")
    boxes = depts.filter(F.col("mail").isNotNull()).select(
        "dept_url", F.lit(None).cast(personal.schema["page_ord"].dataType).alias("page_ord"), F.lit(0).alias("branch"), F.lit(0).alias("idx"),
        F.lit(site.mailbox_name).alias("profesor"), F.col("mail").alias("email"), "departamento",
    )
    rows = boxes.unionByName(personal)
    ordered = rows.orderBy("dept_url", F.asc_nulls_first("page_ord"), "branch", "idx")
    return DepartmentRun(ordered.select("departamento", "profesor", "email"), depts, visited, _failed(lists, cards, facts))


def contacts_clean(pages: DataFrame, list_urls: DataFrame, site: SiteProfile, max_pages: int = 50) -> DepartmentRun:
    """Q6: one contact per address over all departments, names normalised or inferred."""
    pages = _usable(pages)
    lists = _read(pages, list_urls, ("nodes", "clean"), fields=H.LINK_FIELDS, links=H.anchor_structs(""))
    named = DP.marker_links_named(_links(lists, "page_id"), site)
    depts, cards = _sites(pages, named.select("dept_url", "dept_name", F.struct("page_id", "pos").alias("dept_no")), site)
    facts = _host_read(pages, depts, A.near_hits(site.email_domains, site.strict))
    visited = W.walk_relevant(W.co_locate(W.links_of(_links(facts, "url"))), depts, site.walk_keywords, max_pages=max_pages)
    rows = A.with_inferred(H.rows_of(facts, ("url",), F.col("hits"), "email"))
    personal = visited.select(F.col("walk").alias("dept_url"), "url", "ord").join(rows, "url").join(depts.select("dept_url", "dept_name", "dept_no"), "dept_url")
    personal = personal.select("dept_no", F.col("ord").alias("page_ord"), "branch", "idx", F.col("dept_name").alias("departamento"), "profesor", "email")
    boxes = depts.filter(F.col("mail").isNotNull()).select(
        "dept_no", F.lit(0).alias("page_ord"), F.lit(0).alias("branch"), F.lit(0).alias("idx"),
        F.col("dept_name").alias("departamento"), F.lit(site.mailbox_name).alias("profesor"), F.col("mail").alias("email"),
    )
    first = dedup.first_per_email(boxes.unionByName(personal))
    ordered = first.orderBy("dept_no", "page_ord", "branch", "idx")
    return DepartmentRun(ordered.select("departamento", "profesor", "email"), depts, visited, _failed(lists, cards, facts))


def run_summary(run: DepartmentRun, site: SiteProfile) -> DataFrame:
    """A9 + A10: the figures printed at the end of a run, as one row."""
    mailbox = F.col("profesor") == site.mailbox_name
    named = report.is_named(F.col("profesor"), site.mailbox_name)
    people = report.counters(
        run.contacts, total_registros=F.lit(True), con_nombre=named, sin_nombre=~named,
        emails_departamento=mailbox, emails_personal=~F.coalesce(mailbox, F.lit(False)),
    )
    unique = run.contacts.agg(F.count_distinct("email").alias("emails_unicos"))
    sites = report.counters(run.departments, departamentos=F.lit(True), sin_web=F.col("web").isNull())
    rows = people.unionByName(unique, allowMissingColumns=True).unionByName(sites, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
