"""Row-local classifiers of documents and pieces, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages and their frequent words, in the order that settles ties (fixed values).
LANGUAGE_WORDS = {
    "en": "the of and to in is for that with as on by are this from or an be at which we it can has have was were not",
    "es": "el la los las de del que en un una para por con se su es al lo como más pero sus le ya o este porque esta entre cuando muy sin sobre también hasta hay donde desde todo durante todos",
    "pt": "o a os as de do da dos das que em um uma para por com se não mais como mas ao aos é são foi pelo pela",
    "de": "der die das und ist nicht mit den von zu für auf ein eine dem des sich auch als bei werden wird sind aus nach wie oder im zum zur über",
    "fr": "le la les des est une pour dans qui que sur par avec au aux du ce cette sont plus ou mais comme leur",
}

#: Signals over the whole text, first that holds (fixed values).
TEXT_SIGNALS = (
    ("petasa", r"petase|pet hydrolase|poly\(ethylene terephthalate\) hydrolase|ideonella|is ?petase|fast-petase|leaf-branch compost cutinase|lcc"),
    ("hidrolasa_relacionada", r"cutinase|mhetase|lipase|esterase|carboxylesterase|hydrolase|depolymeras"),
    ("contexto_reciclaje", r"recycl|circular economy|waste management|microplastic|biodegrad|plastic"),
)

#: Topic signals of title and abstract (fixed values). Java: lookahead allowed.
PET = r"\bPET\b(?!\s*[/-]\s*(?:CT|MRI|scan|imaging))|polyethylene[- ]terephthalate|poly\(ethylene terephthalate\)|terephthal"
ENZYME = r"enzym|hydrolas|PETase|cutinase|esterase|lipase|depolymeras|MHETase|polyesterase"
PLASTIC = r"plastic|polymer|recycl|polyester|bioplastic|upcycl"

#: Kinds of evidence by section name, first that holds (fixed values).
EVIDENCE = (
    ("introduccion", r"^(?:\d+[.)]?\s*)?(?:introduction|background|overview|state of the art)"),
    ("metodos", r"method|material|experimental|procedure|protocol|preparation|cloning|purification|\bstrains?\b|plasmids?|culture|growth conditions|statistical|data analysis|assays?\b|measurements?$|samples?\b|computational details|simulation (?:setup|details)"),
    ("resultados", r"result|finding|characteri[sz]ation|screening|identification|activity|stability|kinetic|structur|simulation"),
    ("discusion", r"discussion|conclusion|outlook|perspective|future|summary|challenges|limitations|implications|concluding"),
)

#: Section names that are administration, and those whose text is skipped (fixed values).
ADMIN_SECTION = (
    r"^(authors?['’]?\s*contributions?|author information|contributor information|data availability|code availability|materials? availability|availability of|"
    r"reporting summary|competing interests?|declarations?|disclosures?|ethic|supplementary|supporting information|associated data|abbreviations?|glossary|"
    r"additional information|peer review|publisher['’]?s note|open access|credit|institutional review|informed consent|consent to|lead contact|technical contact|"
    r"contact for|correspondence\s*(?:$|:|to\b|and request|should)|data,? code|for correspondence)"
)
SKIPPED_SECTION = r"^(references|bibliography|acknowledge?ments?|footnotes|author contributions|conflicts? of interest|funding|biograph)"
FILLER = r"full text of this (preprint|article) is available as a pdf"
TABLE_LABEL = r"^(?:supplementary\s+|suppl\.?\s+|extended\s+data\s+)?(?:table|tabla|cuadro)\s*\.?\s*\d"
MIN_ABSTRACT = 50

#: Topics: (pattern, weight) (fixed values). Three hits count at most; a hit in the section name counts double.
TOPICS: dict[str, tuple[tuple[str, int], ...]] = {
    "ingenieria_estabilidad": (
        (r"thermostab\w*|thermal(?:ly)? stab\w*|heat[- ]resist\w*", 2), (r"melting temperature|\bT\s?m\b|Δ\s?T\s?m\b", 2),
        (r"directed evolution|rational design|protein engineering|enzyme engineering|computational design|machine learning|deep learning|ProteinMPNN|\bPROSS\b|FoldX|Rosetta", 2),
        (r"\bvariants?\b|\bmutants?\b|\bmutations?\b|mutagenesis|substitutions?", 1), (r"disulfide|stabili[sz]\w*|ΔΔG|salt bridge", 1),
        (r"FAST-PETase|DuraPETase|ThermoPETase|HotPETase|TurboPETase|LCC-?ICCG|\bICCG\b", 2), (r"engineered|improved (?:activity|stability)|enhanced (?:activity|stability)", 1),
    ),
    "descubrimiento_caracterizacion": (
        (r"metagenom\w*|genome mining|bioprospect\w*|uncultured|metatranscriptom\w*", 2), (r"novel (?:PET )?(?:hydrolase|enzyme|polyesterase|cutinase|esterase)|newly (?:identified|discovered)", 2),
        (r"\bisolat(?:ed|ion|es)\b|screening|screened|enrichment", 1), (r"compost|sediment|sponge|deep[- ]sea|marine|soil sample|hot spring", 1),
        (r"putative|homolog\w*|phylogen\w*|sequence (?:similarity|identity|alignment)|\bHMM\b|BLAST|clade|subfamily", 1), (r"discover\w*|identif(?:ied|ication) of", 1),
        (r"(?:biochemical )?characteri[sz]ation of", 1), (r"Ideonella|sakaiensis|201-F6|bacterium|bacterial strain", 1),
    ),
    "reciclaje_economia_circular": (
        (r"circular economy|closed[- ]loop|circularity", 2), (r"recycl\w*|upcycl\w*|valori[sz]\w*", 2),
        (r"sustainab\w*|waste management|life[- ]cycle|techno-?economic|feedstock|bio-?based|value-added", 1), (r"mechanical recycling|chemical recycling|glycolysis|pyrolysis|methanolysis|solvolysis", 2),
        (r"post-?consumer|plastic waste|waste plastic|\bwaste\b", 1), (r"industrial(?:ly)?|scale[- ]up|large[- ]scale|commerciali[sz]\w*", 1),
    ),
    "biodegradacion_ambiente": (
        (r"microplastic\w*|nanoplastic\w*|plastisphere", 2), (r"pollution|ecosystem|ecolog\w*|marine litter|ocean|aquatic|landfill|bioremediation|environmental (?:impact|fate|persistence)", 1),
        (r"biodegrad\w*", 1), (r"microbial communit\w*|microbiome|consortium|consortia|biofilm|relative abundance|\b16S\b", 2), (r"toxic\w*|human health|exposure|ingestion", 1),
        (r"\bsoil\b|\bsea\b|freshwater|wastewater|sludge", 1),
    ),
    "produccion_sistemas_celulares": (
        (r"surface display|cell[- ]surface|yeast display|whole[- ]cell|biocatalyst\w*", 2), (r"heterologous|recombinant|expression (?:system|host|vector|level)|overexpress\w*|\bexpressed\b", 1),
        (r"E\. coli|Escherichia coli|Pichia|Saccharomyces|Bacillus subtilis|Corynebacterium|Yarrowia|chloroplast|microalga\w*|chassis", 1),
        (r"secretion|signal peptide|fusion protein|inclusion bod\w*|His-?tag|purif(?:ied|ication)|Ni-?NTA|affinity chromatography", 1),
        (r"immobili[sz]\w*|fermentation|bioreactor|fed-batch|titer", 2), (r"plasmid|cloning|transformant|induction|IPTG|OD600", 1),
    ),
    "mecanismo_simulacion": (
        (r"molecular dynamics|\bMD simulations?\b|QM/MM|\bDFT\b|density functional|docking|free[- ]energy|kcal/?\s?mol|GROMACS|AMBER|CHARMM|metadynamics", 2),
        (r"catalytic (?:triad|mechanism|residue|site|cycle)|oxyanion|tetrahedral intermediate|acyl-?enzyme|nucleophilic attack", 2),
        (r"active site|binding (?:site|affinity|energy|pocket|cleft|mode)|substrate[- ]binding|subsite", 1), (r"crystal structure|X-?ray|cryo-?EM|\bPDB\b", 1),
        (r"conformation\w*|\bRMSD\b|\bRMSF\b|hydrogen bond|electrostatic|hydrophobic", 1), (r"mechanis(?:m|tic) (?:insight|study|investigation)", 1),
    ),
    "productos_despolimerizacion": (
        (r"terephthalic acid|\bTPA\b|\bMHET\b|\bBHET\b|mono\(2-hydroxyethyl\)|bis\(2-hydroxyethyl\)|MHETase", 3), (r"ethylene glycol|\bEG\b", 1),
        (r"monomer\w*|oligomer\w*|degradation products?|hydrolysis products?|soluble products?|product release", 1), (r"depolymeri[sz]\w*|PET hydrolysis", 1),
    ),
}
TOPIC_LEAST, TOPIC_SECOND = 4, 0.6

I = "(?iU)"  # noqa: E741 - case-blind, with Unicode word classes


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(*cols: Column) -> list[Column]:
    return [F.coalesce(c, F.lit("")) for c in cols]


def license_name(lic: Column) -> Column:
    """Lower case, blanks and underscores as hyphens, without the version; ``(sin declarar)`` for none."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(lic, F.lit("")))), r"[\s_]+", "-")
    return F.when(plain == "", F.lit("(sin declarar)")).otherwise(F.regexp_replace(plain, r"-(\d+(\.\d+)?)$", ""))


def relevance(title: Column, abstract: Column, text: Column) -> Column:
    """First text signal that title, abstract or the first 4000 characters hold."""
    base = F.concat_ws(" ", *text_of(title, abstract), F.substring(F.coalesce(text, F.lit("")), 1, 4000))
    out = F.lit("sin_senal")
    for name, pattern in reversed(TEXT_SIGNALS):
        out = F.when(base.rlike(I + pattern), F.lit(name)).otherwise(out)
    return out


def document_relevance(doc_type: Column, title: Column, abstract: Column, text: Column) -> Column:
    """Scope of a document from title and abstract; from the text's start where the abstract is short."""
    t, a, x = text_of(title, abstract, text)
    base = F.concat_ws(" ", t, F.when(F.length(a) >= MIN_ABSTRACT, a).otherwise(F.substring(x, 1, 1500)))
    pet, enzyme, plastic = (base.rlike(I + p) for p in (PET, ENZYME, PLASTIC))
    return (
        F.when(doc_type.isin("structure", "prediction"), "estructura").when(pet & enzyme, "nucleo_pet_enzima")
        .when(enzyme & plastic, "enzima_plasticos_sin_pet").when(pet | plastic, "plasticos_sin_enzima").otherwise("fuera_de_alcance")
    )


def _among(words: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*words)


def language(text: Column) -> Column:
    """Language by script and frequent words over the text's first 1500 characters."""
    t = F.substring(F.coalesce(text, F.lit("")), 1, 1500)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    cjk = F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"))
    cyrillic = F.regexp_count(t, F.lit(r"(?=\p{L})[\x{0400}-\x{04ff}]"))
    words = F.slice(F.regexp_extract_all(F.lower(t), F.lit(r"[a-zà-ÿ]+"), F.lit(0)), 1, 300)

    def vote(w: Column) -> Column:
        hits = F.array(*[F.struct(F.size(F.filter(w, _among(v.split()))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(LANGUAGE_WORDS.items())])
        return let(F.array_max(hits), lambda best: F.when((F.size(w) > 0) & (best["n"] >= 0.12 * F.size(w)), best["k"]).otherwise("desconocido"))

    return F.when((letters >= 12) & (cjk / letters > 0.3), "cjk").when(letters < 40, "desconocido").when(cyrillic / letters > 0.2, "cirilico").otherwise(let(words, vote))


def is_table_line(line: Column) -> Column:
    """A table label, or a long line dense in digits and signs with hardly a sentence."""
    dense = F.regexp_count(line, F.lit(r"[\p{Nd}±×−\-/()\[\]%]")) / F.length(line)
    return line.rlike(r"(?iU)" + TABLE_LABEL) | ((F.length(line) >= 400) & (dense > 0.12) & (F.regexp_count(line, F.lit(r"[.;]\s+[A-Z]")) < F.length(line) / 600))


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def topic_scores(text: Column, section: Column) -> dict[str, Column]:
    # lower case on both sides: matching without regard to case is slow
    text, section = F.lower(text), F.lower(F.coalesce(section, F.lit("")))
    out = {}
    for topic, rules in TOPICS.items():
        parts = [F.least(F.regexp_count(text, F.lit("(?U)" + p.lower())), F.lit(3)) * w + F.when(section.rlike("(?U)" + p.lower()), 2 * w).otherwise(0) for p, w in rules]
        out[topic] = sum(parts[1:], parts[0]).cast("int")
    return out


def top_topics(scores: dict[str, Column]) -> Column:
    """Struct of the first and second topic; null under the threshold. Ties go to declaration order."""
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]))

    def pick(r: Column) -> Column:
        first = F.when(-r[0]["s"] >= TOPIC_LEAST, r[0]["k"])
        second = F.when((-r[0]["s"] >= TOPIC_LEAST) & (-r[1]["s"] >= TOPIC_LEAST) & (-r[1]["s"] >= TOPIC_SECOND * -r[0]["s"]), r[1]["k"])
        return F.struct(first.alias("subtopic"), second.alias("subtopic_secondary"))

    return let(ranked, pick)


def evidence_type(section: Column, doc_type: Column, is_table: Column) -> Column:
    """Kind of evidence from the document's type and the section's name."""
    out = F.lit("otro")
    for name, pattern in reversed(EVIDENCE):
        out = F.when(F.coalesce(section, F.lit("")).rlike(I + pattern), F.lit(name)).otherwise(out)
    return F.when(doc_type == "structure", "estructura").when(doc_type == "prediction", "prediccion").when(is_table, "tabla").when(section == "Resumen", "resumen").otherwise(out)


def quality_marks(text: Column, section: Column) -> Column:
    """Marks of a doubtful piece: cut start, open end, short, reference list, generic section."""
    def mark(c: Column, name: str) -> Column:
        return F.when(c, F.lit(name))

    return F.array_compact(F.array(
        mark(text.rlike(r"^\s*\p{Ll}"), "starts_lower"), mark(~text.rlike(r"[.!?:;)\]\"”»]\s*$"), "open_end"), mark(tokens(text) < 40, "short"),
        mark(F.regexp_count(text, F.lit(r"\[\d+\]|\(\d{4}\)|et al")) > 4, "references"), mark(F.coalesce(section, F.lit("")).isin("", "Texto", "Body", "Main"), "generic_section"),
    ))

