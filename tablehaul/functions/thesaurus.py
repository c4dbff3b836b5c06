"""Built-in multilingual thesaurus as a table (term, concept)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Concept, then its terms in other languages.
THESAURUS = {
    "klant": ["customer", "client", "kunde"],
    "naam": ["name", "naam", "bezeichnung"],
    "adres": ["address", "adresse"],
    "land": ["country", "land", "pais"],
    "bedrag": ["amount", "betrag", "montant"],
    "datum": ["date", "datum", "fecha"],
    "nummer": ["number", "nummer", "numero"],
    "code": ["code", "kode"],
    "beschrijving": ["description", "beschreibung", "descripcion"],
    "status": ["status", "staat"],
    "actief": ["active", "aktiv"],
    "blokkeren": ["block", "blockieren"],
    "vlag": ["flag", "flagge"],
    "controle": ["control", "kontrolle"],
    "indicatie": ["indicator", "indikator"],
    "bank": ["bank", "banco"],
    "rekening": ["account", "konto", "cuenta"],
    "saldo": ["balance", "saldo"],
    "transactie": ["transaction", "transaktion"],
    "betaling": ["payment", "zahlung", "pago"],
    "overboekingen": ["transfer", "uberweisung"],
    "sleutel": ["key", "schlussel", "clave"],
    "waarde": ["value", "wert", "valor"],
    "type": ["type", "typ", "tipo"],
    "referentie": ["reference", "referenz", "referencia"],
    "versie": ["version", "version"],
    "configuratie": ["configuration", "konfiguration"],
}


def thesaurus_rows() -> list[tuple[str, str]]:
    return sorted({(term, concept) for concept, terms in THESAURUS.items() for term in [concept, *terms]})


def thesaurus_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(thesaurus_rows(), "term string, concept string")
