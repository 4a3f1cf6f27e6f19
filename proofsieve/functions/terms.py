"""Section names with their aliases and signal terms, stop words, claim hints."""

from __future__ import annotations

#: Fixed values. Section key to (display name, slug).
SECTIONS = {
    "business": ("Business", "business"),
    "risk_factors": ("Risk Factors", "risk_factors"),
    "md&a": ("MD&A", "md_and_a"),
    "market_risk": ("Market Risk", "market_risk"),
}

#: Fixed values. Names under which a section is filed, in the order in which they are tried.
ALIASES = {
    "business": ["business", "item 1", "item1", "company business"],
    "risk_factors": ["risk factors", "risk factor", "item 1a", "item1a"],
    "md&a": ["md&a", "management discussion and analysis", "managements discussion and analysis", "management discussion & analysis", "item 7", "item7"],
    "market_risk": ["market risk", "quantitative and qualitative disclosures about market risk", "item 7a", "item7a"],
}

#: Fixed values. Terms of a question that point to a section.
SIGNAL_TERMS = {
    "business": [
        "business", "products", "product", "services", "customers", "customer", "markets", "distribution", "competition", "competitive",
        "research and development", "r&d", "segments", "platforms", "offerings", "operations",
    ],
    "risk_factors": [
        "risk factors", "risk factor", "supply chain risk", "supply chain", "supplier risk", "suppliers", "regulatory risk", "legal risk",
        "privacy risk", "cybersecurity risk", "data security", "geopolitical", "trade restrictions", "export controls", "manufacturing risk",
        "defects", "third-party", "environmental goals", "uncertainty", "volatility", "dependency",
    ],
    "md&a": [
        "md&a", "management discussion", "revenue", "net sales", "sales", "growth", "demand", "gross margin", "operating income",
        "operating expenses", "expenses", "cash flow", "liquidity", "capital resources", "capital expenditures", "capex",
        "share repurchases", "dividends", "results of operations", "performance",
    ],
    "market_risk": [
        "market risk", "foreign currency", "foreign exchange", "exchange rate", "exchange rates", "interest rate", "interest rates",
        "hedging", "hedge", "derivative", "derivatives", "investment portfolio", "investments", "securities", "fair value",
        "sensitivity analysis", "credit risk", "counterparties", "counterparty", "cash equivalents", "short-term investments",
    ],
}

#: Fixed values. Words that don't count as content.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that",
    "the", "their", "this", "to", "was", "were", "with",
]

#: Fixed values. Words that mark a sentence as a claim.
CLAIM_HINTS = [
    "business", "cash", "competition", "customer", "demand", "decline", "exposure", "financial", "flow", "generated", "grew", "growth",
    "guidance", "income", "increase", "inventory", "margin", "market", "product", "products", "profit", "regulatory", "revenue", "risk",
    "risks", "sales", "segment", "services", "share", "supply",
]
