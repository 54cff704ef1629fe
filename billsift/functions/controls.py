"""Rules over what a page shows: controls that open documents, labels that lead to billing, cells of table rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values
from .binding import bound

# The vocabulary of controls, sections and headers, in the languages that are supported.
SETTINGS = r"(?:settings|preferences|inställningar|einstellungen|paramètres|configuración|configurações|impostazioni|instellingen)"
BILLING = (
    r"(?:account|billing|subscriptions?|invoice\s+history|receipt\s+history|billing\s+history|past\s+invoices?|fakturering|abonnemang|fakturahistorik|kvittohistorik"
    r"|abrechnung|rechnungen?|rechnungshistorie|abonnements?|facturation|historique\s+des\s+factures|facturación|suscripciones|historial\s+de\s+facturas"
    r"|faturamento|faturação|assinaturas|histórico\s+de\s+faturas|fatturazione|abbonamenti|cronologia\s+fatture|facturering|abonnementen|factuurgeschiedenis)"
)
EXPLICIT_ACTION = r"(?iu)(?:download|save|get|pdf|ladda\s*ner|hämta|herunterladen|télécharger|descargar|baixar|scarica|downloaden)"
DOCUMENT_CONTEXT = (
    r"(?iu)(?:invoices?|receipts?|statements?|transactions?|\binv[_-][a-z0-9]+|\brcpt[_-][a-z0-9]+|billing\s+history|payment\s+history|past\s+(?:payments|charges)"
    r"|kvitto|faktura|beleg|rechnung|reçu|facture|recibo|factura|ricevuta|fattura)"
)
UNRELATED = r"(?i)(?:^|[\s._/-])(?:guides?|manuals?|help|polic(?:y|ies)|privacy|terms|instructions?)(?:$|[\s._/-])"
DOCUMENT_ICON = r"(?i)(?:^|[\s_-])(?:download|file-down|file-text|receipt|scroll-text|document|invoice|pdf)(?:$|[\s_-])"
INVOICE_CONTEXT = r"(?iu)(?:billing|past\s+invoices?|invoice\s+history|receipt\s+history|statement|receipt|invoice|kvitto|faktura|beleg|rechnung|reçu|facture|recibo|factura|ricevuta|fattura)"
INVOICE_ROW = (
    r"(?iu)(?:invoice|receipt|statement|kvitto|faktura|beleg|rechnung|reçu|facture|recibo|factura|ricevuta|fattura"
    r"|\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b(?:USD|EUR|SEK|NOK|DKK|GBP|CHF)\b)"
)
ACTION_COLUMN = r"(?i)^(?:actions?|documents?|downloads?|invoices?|receipts?)$"
UNSAFE_LABEL = r"(?i)(?:\b(?:delete|remove|cancel|pay|purchase|checkout|upgrade|downgrade|authorize|logout)\b|sign\s*out|log\s*out)"
INVOICE_SECTION = r"(?i)^(?:invoices?|invoice history|receipts?|receipt history|billing history|past invoices?)$"
NAVIGATION = rf"(?iu)^(?:(?:[^,]{{1,80}},\s*)?(?:open\s+)?(?:profile|account)(?:\s+menu)?|{SETTINGS}|{BILLING})$"
NUMBER_HEADER = r"(?i)(?:invoice|receipt|statement|reference|document).*(?:number|no\.?|#|id)|^(?:number|no\.?|invoice|receipt|statement)$"
OTHER_DATE_HEADER = r"(?i)(?:due|paid|period|service|subscription|renew)"
DATE_HEADER = r"(?i)date"
TOTAL_HEADER = r"(?i)^(?:total|amount|gross|invoice amount|amount paid|paid)$"
CURRENCY_HEADER = r"(?i)^(?:currency|ccy)$"
SECRET_WORD = r"(?i)(?:token|secret|signature|bearer|eyJ[A-Za-z0-9_-]{20,})"
ROW_TOKEN = r"(?i)(?<![A-Za-z0-9_])([A-Z][A-Z0-9-]{5,79})(?<=[A-Za-z0-9])(?![A-Za-z0-9_])"


def bounded(c: Column, most: int) -> Column:
    """Text with single blanks, trimmed, `most` characters at most; empty for null."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, most)


def control_basis(material: Column, row: Column, column: Column, table: Column, page: Column, usable: Column) -> Column:
    """Why a control is taken to open an invoice: explicit_document_label, invoice_context_action, invoice_table_action; else null.

    `material` is what the control itself says; `row`, `column`, `table`, `page` are the texts around it; `usable` is true
    for a control that is visible, enabled and not part of a form.
    """
    material, row, column, table, page = bounded(material, 320), bounded(row, 500), bounded(column, 120), bounded(table, 500), bounded(page, 240)
    refused = ~F.coalesce(usable, F.lit(False)) | (material == "") | material.rlike(UNSAFE_LABEL) | material.rlike(UNRELATED)
    explicit, near = material.rlike(EXPLICIT_ACTION), F.concat_ws(" ", table, page).rlike(INVOICE_CONTEXT)
    listed = material.rlike(DOCUMENT_ICON) & column.rlike(ACTION_COLUMN) & (row.rlike(INVOICE_ROW) | table.rlike(INVOICE_CONTEXT)) & near
    return (
        F.when(refused, F.lit(None).cast("string"))
        .when(explicit & material.rlike(DOCUMENT_CONTEXT), "explicit_document_label")
        .when(explicit & F.concat_ws(" ", row, table, page).rlike(DOCUMENT_CONTEXT), "invoice_context_action")
        .when(listed, "invoice_table_action")
    )


def is_invoice_section(label: Column) -> Column:
    return bounded(label, 120).rlike(INVOICE_SECTION)


def is_navigation_label(label: Column) -> Column:
    """Whether a label leads to settings or billing, and to nothing that changes an account."""
    text = bounded(label, 120)
    return ~text.rlike(UNSAFE_LABEL) & text.rlike(NAVIGATION)


def is_menu_trigger(popup: Column, visible: Column, enabled: Column, form_backed: Column) -> Column:
    """Whether a control may be opened to see what its menu has; unknown flags count as false."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return flag(popup) & flag(visible) & flag(enabled) & ~flag(form_backed)


def row_token(text: Column) -> Column:
    """The one word of a row that looks like an invoice number: a letter first, 6 to 80 characters, three digits or more; null if there are several."""
    words = F.array_distinct(F.regexp_extract_all(bounded(text, 500), F.lit(ROW_TOKEN), F.lit(1)))
    numbered = F.filter(words, lambda w: (F.length(F.regexp_replace(w, r"\D", "")) >= 3) & ~w.rlike(SECRET_WORD))
    return bound(numbered, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0))))


def row_claim(headers: Column, cells: Column, row: Column | None = None) -> Column:
    """What a table row says of its invoice, as struct<number,issued,total,currency>; null if it says nothing.

    Header and cell belong together by their place. A cell counts for the first field that its header names and that no
    earlier cell has given. Without a number, the `row`'s single invoice-like word is it.
    """
    pairs = F.transform(
        F.arrays_zip(headers.alias("header"), cells.alias("cell")),
        lambda x: F.struct(F.lower(bounded(x["header"], 120)).alias("header"), bounded(x["cell"], 240).alias("text")),
    )
    nothing = F.lit(None).cast("string")
    empty = F.struct(nothing.alias("number"), nothing.alias("issued"), nothing.alias("total"), nothing.alias("currency"))

    def told(s: Column, x: Column) -> Column:
        header, free = x["header"], lambda field: s[field].isNull()
        field = F.when((header == "") | (x["text"] == ""), None).when(free("number") & header.rlike(NUMBER_HEADER), "number").when(
            free("issued") & header.rlike(DATE_HEADER) & ~header.rlike(OTHER_DATE_HEADER), "issued",
        ).when(free("total") & header.rlike(TOTAL_HEADER), "total").when(free("currency") & header.rlike(CURRENCY_HEADER), "currency")
        return bound(field, lambda f: bound(F.when(f == "total", values.displayed_amount(x["text"])), lambda amount: given(s, x["text"], f, amount)))

    def given(s: Column, text: Column, field: Column, amount: Column) -> Column:
        code = F.nullif(F.upper(F.regexp_extract(text, r"(?<![A-Za-z0-9_])([A-Za-z]{3})(?![A-Za-z0-9_])", 1)), F.lit(""))
        beside = F.when(amount.isNotNull(), F.coalesce(values.currency_of(text), s["currency"])).when(field == "currency", code).otherwise(s["currency"])
        return F.struct(
            F.when(field == "number", text).otherwise(s["number"]).alias("number"),
            F.when(field == "issued", values.displayed_date(text)).otherwise(s["issued"]).alias("issued"),
            F.when(field == "total", amount).otherwise(s["total"]).alias("total"), beside.alias("currency"),
        )

    def whole(found: Column) -> Column:
        number = F.coalesce(found["number"], row_token(row)) if row is not None else found["number"]
        return F.struct(number.alias("number"), found["issued"].alias("issued"), found["total"].alias("total"), found["currency"].alias("currency"))

    says = lambda c: F.when(F.coalesce(c["number"], c["issued"], c["total"], c["currency"]).isNotNull(), c)
    return bound(bound(F.aggregate(pairs, empty, told), whole), says)


def action_identity(attribute: Column, claim: Column) -> Column:
    """32 hex digits that name a row's document by the strongest that is known alone: an attribute `name=value`, the invoice number, or date, total and currency.

    Null without any; what a label says or where a row stands never counts.
    """
    safe = F.when((bounded(attribute, 160) != "") & ~attribute.rlike(SECRET_WORD), bounded(attribute, 160))
    number = F.concat(F.lit("invoice="), F.nullif(bounded(claim["number"], 160), F.lit("")))
    dated = F.concat(F.lit("date="), claim["issued"], F.lit("\u0001total="), claim["total"], F.lit("\u0001currency="), claim["currency"])
    return F.substring(F.sha2(F.coalesce(safe, number, dated), 256), 1, 32)
