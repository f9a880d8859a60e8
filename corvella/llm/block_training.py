"""Fits the block labeller: ``python -m corvella.llm.block_training TABLES_DIR [OUT]``.

The tables carry no labels, so a bounded sample of page chunks (SAMPLE, the first by hash of the id) is labelled by a teacher:
phrases that mark menus, consent notices, boxes and footers, and a rule for the entries under a box's heading.  Titles made of the
page's own words are put between its sentences (TITLES), so that the network learns that a short line is no box by itself.
The network sees neither the phrases nor the rule, only hashed words, marks and the page around a line.  Words are
dropped at random in training, so that it learns to lean on marks and context where words are new.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np

from corvella.llm.main_content import HIDDEN, INPUT, MODEL, PATH_SIZE, BlockLabeller, Vectors, block_path, text_blocks

SAMPLE, HELD_OUT = 7_000, 1_000
EPOCHS, BATCH, RATE, WORD_DROP, TITLES = 20, 64, 3e-3, 0.1, 0.6

# Labels of menus in three languages.
MENU = """Home|Products|Pricing|Docs|Blog|About us|Contact|Support|Careers|Press|Log in|Sign up|Search|Cart|My account|Help centre|Community|Events|Partners|Status|Downloads|Locations|Newsroom|Case studies|Services|Shop|Account|News|FAQ|Privacy|Terms
Startseite|Produkte|Preise|Über uns|Kontakt|Karriere|Presse|Anmelden|Registrieren|Suche|Warenkorb|Mein Konto|Hilfe|Termine|Partner|Standorte|Aktuelles|Dienste|Datenschutz|Impressum
Accueil|Produits|Tarifs|À propos|Contact|Aide|Carrières|Presse|Connexion|Inscription|Recherche|Panier|Mon compte|Agenda|Partenaires|Actualités|Boutique""".replace("\n", "|").split("|")
# Beginnings of consent notices and their buttons.
CONSENT = """We use cookies|This site stores small files|Some of these trackers|Your privacy matters to us|Manage choices|Accept all|Reject all|Only necessary|OK, got it|[x] Close|Settings
Wir verwenden Cookies|Diese Seite speichert kleine|Alle akzeptieren|Nur notwendige|Ablehnen|Verstanden|Einstellungen
Nous utilisons des cookies|Ce site enregistre de petits|Tout accepter|Tout refuser|Personnaliser|Paramètres|J'ai compris""".replace("\n", "|").split("|")
_CONSENT_BODY = re.compile(r"(?:and|und|et) \d+ (?:partners process|Partner verarbeiten|partenaires traitent)")
# Headings of boxes and single lines of boxes.
BOX = """Related articles|In this section|Popular tags|Most read this week|Recent comments|You may also like|Advertisement|Subscribe to our newsletter|Share this page|Follow |Results for |Download the free |Get \\d+ tips
Ähnliche Beiträge|Das könnte Sie auch|Meistgelesen|Letzte Kommentare|Schlagworte|Anzeige|Newsletter abonnieren|Seite teilen|Ergebnisse für |In diesem Abschnitt|Folgen Sie
Articles liés|Vous aimerez aussi|Les plus lus|Derniers commentaires|Mots-clés|Publicité|S'abonner à la lettre|Partager cette page|Résultats pour |Dans cette rubrique|Suivez """.replace("\n", "|").split("|")
_BOX = re.compile("^(?:" + "|".join(BOX) + ")")
_GERMAN_BOX = re.compile("^(?:" + "|".join(BOX[13:24]) + ")")
# What footers hold.
_FOOTER = re.compile(
    r"^(?:©|Copyright \d{4}|Registered office|Phone \S+ \| Fax|Tel\S* \S+ \||Language: |Legal notice ·|Terms of use \||AGB \||Conditions \||Barrierefreiheit ·|Accessibilité ·|Back to top|Nach oben|Haut de page|Sprache: |Langue : )"
    r"|, \d+ (?:Mill Lane|rue du Moulin)|, Mühlgasse \d+|(?:Postbox|Postfach|, BP) \d+$|All rights reserved\.$|Alle Rechte vorbehalten\.$|Tous droits réservés\.$"
)
# Headings that an article has besides its titles.
_HEADING = re.compile(r"^(?:(?:Step|Schritt|Étape) \d+|What we measured|Why it failed|Was gemessen wurde|Ce qui a été mesuré|Warum es|Pourquoi cela)")
_SPLIT = re.compile(r"\s+[|/·>»•]\s+|\s{2,}|\t")
_MENU = {m.casefold() for m in MENU}


def _menu_part(part: str) -> bool:
    return re.sub(r"\s*\(\d+\)$", "", part.strip().casefold()) in _MENU


def teach(lines: list[str]) -> list[int]:
    """1 for boilerplate, for the lines of a page that are not blank."""
    out: list[int] = []
    box = nouns = False
    for line in lines:
        s = line.strip()
        core = re.sub(r"^[-*•›»]\s+", "", s)
        parts = [p for p in _SPLIT.split(core) if p]
        sentence = s[-1:] == "." and len(s.split()) > 6
        known = sum(map(_menu_part, parts))
        if _FOOTER.search(s):
            label, box = 1, False
        elif any(s.startswith(c) for c in CONSENT) or _CONSENT_BODY.search(s):
            label, box = 1, False
        elif known == len(parts) or (not sentence and len(parts) > 1 and known >= 1 and s[-1:] != "."):
            label, box = 1, False
        elif _BOX.match(s) and not sentence:
            label, box, nouns = 1, True, bool(_GERMAN_BOX.match(s))
        elif sentence or s[-1:] in ".!:" or _HEADING.match(s):
            label, box = 0, False
        elif box:
            # entries: phrases in lower case (but for German nouns), dates, counts, marks, long questions; a short capitalised line is a title again
            entry = (nouns and len(s.split()) <= 4) or s[:1].islower() or core != s or re.search(r"\(\d+\)$", s) or s[:1].isdigit() or len(s.split()) > 6
            label = 1 if entry else 0
            box = bool(entry)
        else:
            label = 0
        out.append(label)
    return out


def _gradient(a: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients for pages padded to one length: x (pages, blocks, INPUT), y and mask (pages, blocks)."""
    pages, blocks, _ = x.shape
    H = HIDDEN
    memory = []
    for d in range(2):
        xs = x if d == 0 else x[:, ::-1]
        ms = mask if d == 0 else mask[:, ::-1]
        inputs = xs @ a["wx"][d] + a["b"][d]
        h, c = np.zeros((pages, H), np.float32), np.zeros((pages, H), np.float32)
        steps = []
        for t in range(blocks):
            m = ms[:, t, None]
            z = inputs[:, t] + h @ a["wh"][d]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * H], -30, 30)))
            i, f, o, g = gates[:, :H], gates[:, H : 2 * H], gates[:, 2 * H :], np.tanh(z[:, 3 * H :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            steps.append((h, c, i, f, o, g, tc, m))
            h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
            steps[-1] += (h,)
        memory.append((xs, steps))
    up = np.stack([s[8] for s in memory[0][1]], 1)
    down = np.stack([s[8] for s in memory[1][1]], 1)[:, ::-1]
    both = np.concatenate([up, down], 2)
    p = 1 / (1 + np.exp(-np.clip(both @ a["wo"] + a["bo"], -30, 30)))
    n = mask.sum()
    loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
    dz = mask * (p - y) / n
    grads = {k: np.zeros_like(v) for k, v in a.items()}
    grads["wo"] = np.einsum("pbh,pb->h", both, dz)
    grads["bo"] = np.array(dz.sum(), np.float32)
    dboth = dz[:, :, None] * a["wo"]
    for d in range(2):
        xs, steps = memory[d]
        dout = dboth[:, :, :H] if d == 0 else dboth[:, ::-1, H:]
        dh, dc = np.zeros((pages, H), np.float32), np.zeros((pages, H), np.float32)
        dzs = np.zeros((pages, blocks, 4 * H), np.float32)
        for t in range(blocks - 1, -1, -1):
            h0, c0, i, f, o, g, tc, m, _ = steps[t]
            dh = dh + dout[:, t]
            dh2, dc2 = m * dh, m * dc
            dct = dc2 + dh2 * o * (1 - tc * tc)
            dzt = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), dh2 * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
            dzs[:, t] = dzt
            grads["wh"][d] += h0.T @ dzt
            dh = dzt @ a["wh"][d].T + (1 - m) * dh
            dc = dct * f + (1 - m) * dc
        grads["wx"][d] = np.tensordot(xs, dzs, ([0, 1], [0, 1]))
        grads["b"][d] = dzs.sum((0, 1))
    return loss, grads


def train(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 1) -> BlockLabeller:
    """Adam over shuffled batches of pages of like length."""
    rng = np.random.default_rng(seed)
    H = HIDDEN
    a = {
        "wx": (rng.standard_normal((2, INPUT, 4 * H)) * INPUT**-0.5).astype(np.float32),
        "wh": (rng.standard_normal((2, H, 4 * H)) * H**-0.5).astype(np.float32),
        "b": np.zeros((2, 4 * H), np.float32),
        "wo": (rng.standard_normal(2 * H) * H**-0.5).astype(np.float32),
        "bo": np.zeros((), np.float32),
    }
    a["b"][:, H : 2 * H] = 1
    m1, m2 = {k: np.zeros_like(v) for k, v in a.items()}, {k: np.zeros_like(v) for k, v in a.items()}
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    step = 0
    for epoch in range(EPOCHS):
        losses = []
        for b in rng.permutation(len(batches)):
            some = [pages[i] for i in batches[b]]
            longest = max(len(y) for _, y in some)
            x, y, mask = np.zeros((len(some), longest, INPUT), np.float32), np.zeros((len(some), longest), np.float32), np.zeros((len(some), longest), np.float32)
            for r, (px, py) in enumerate(some):
                x[r, : len(py)], y[r, : len(py)], mask[r, : len(py)] = px, py, 1
            x[:, :, PATH_SIZE:] *= rng.random((len(some), longest, 1)) >= WORD_DROP
            loss, grads = _gradient(a, x, y, mask)
            losses.append(loss)
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * min(1.0, 5 / (size + 1e-9)) * (0.5 ** (epoch / 7))
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                a[k] = (a[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch} loss {np.mean(losses):.4f}", flush=True)
    return BlockLabeller(a)


def with_titles(lines: list[str], labels: list[int], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """A page with some made-up titles before its sentences: two to five words of the article, the first one capitalised."""
    words = [w for x, y in zip(lines, labels) if not y for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", x)]
    out, marks = [], []
    for x, y in zip(lines, labels):
        after_box = bool(marks) and marks[-1] == 1  # there, a title and an entry look alike
        if words and not y and x.strip()[-1:] == "." and rng.random() < TITLES / (12 if after_box else 3):
            title = " ".join(rng.choice(words, rng.integers(2, 6)).tolist())
            out.append(title[0].upper() + title[1:])
            marks.append(0)
        out.append(x)
        marks.append(y)
    return out, marks


def labelled_pages(texts: list[str], seed: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of pages; with a seed, the pages get made-up titles."""
    vectors, out, rng = Vectors(), [], np.random.default_rng(seed)
    for t in texts:
        _, blocks = text_blocks(t)
        if not blocks:
            continue
        lines = [b for _, b in blocks]
        labels = teach(lines)
        if seed is not None:
            lines, labels = with_titles(lines, labels, rng)
            gaps = ["gap" in p for p, _ in blocks]
            blocks = [(block_path(x, bool(gaps[min(i, len(gaps) - 1)])), x) for i, x in enumerate(lines)]
        out.append((vectors.matrix(blocks), np.array(labels, np.float32)))
    return out


def main(tables: str, out: str = str(MODEL)) -> None:
    import pyarrow.parquet as pq

    assets = pq.read_table(f"{tables}/assets.parquet", columns=["asset_id", "asset_type"]).to_pandas()
    urls = set(assets.asset_id[assets.asset_type == "url"])
    chunks = pq.read_table(f"{tables}/chunks.parquet", columns=["chunk_id", "chunk_asset_id", "chunk_text"]).to_pandas()
    chunks = chunks[chunks.chunk_asset_id.isin(urls)].drop_duplicates("chunk_id")
    chunks = chunks.assign(h=[hash((int(i) * 2654435761) % (1 << 32)) for i in chunks.chunk_id]).sort_values("h").head(SAMPLE + HELD_OUT)
    texts = [t for t in chunks.chunk_text if t]
    model = train(labelled_pages(texts[HELD_OUT:], seed=1))
    Path(out).parent.mkdir(exist_ok=True)
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in model.a.items()})
    model = BlockLabeller.load(out)
    held = labelled_pages(texts[:HELD_OUT])
    p = model.scores(model.projected(np.concatenate([x for x, _ in held])), [len(y) for _, y in held]) >= 0.5
    y = np.concatenate([y for _, y in held]) > 0
    print(f"held out: {len(y)} lines, agreement {np.mean(p == y):.4f}, precision {np.mean(y[p]):.4f}, recall {np.mean(p[y]):.4f}")


if __name__ == "__main__":
    main(*sys.argv[1:])
