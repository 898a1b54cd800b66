"""Small numpy fits run inside pandas UDFs (no Spark objects at import)."""

import numpy as np
import pandas as pd


KNOWN = 20_000  # interval vectors whose sums a task remembers (some 1 KB each)


def uniform_of(key, salt):
    """Repeatable numbers in [0, 1) from whole-number keys and a salt (the splitmix64 finaliser)."""
    z = np.asarray(key).astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2 ** 64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)) / 2.0 ** 64


def ridge_from_sums(d, alpha=1.0):
    """Weighted ridge (free intercept) of d features from weighted sums, one fit a row.

    The returned function takes the columns sum w, sum w y, the d sums w z_i, the
    d sums w z_i y and the sums w z_i z_j (i <= j, row by row), and gives the d
    coefficients and the prediction at z = 1 as columns c0..c<d>.
    """
    def fit(*sums: pd.Series) -> pd.DataFrame:
        m = np.column_stack([c.to_numpy(dtype=float) for c in sums])
        sw = m[:, :1]
        ym, zm, zy = m[:, 1] / sw[:, 0], m[:, 2:2 + d] / sw, m[:, 2 + d:2 + 2 * d]
        A = np.empty((len(m), d, d))
        r, c = np.triu_indices(d)
        A[:, r, c] = A[:, c, r] = m[:, 2 + 2 * d:]
        A += alpha * np.eye(d) - sw[:, :, None] * zm[:, :, None] * zm[:, None, :]
        b = zy - sw * zm * ym[:, None]
        coef = np.linalg.solve(A, b[:, :, None])[:, :, 0]
        at_one = ym + (coef * (1.0 - zm)).sum(axis=1)
        return pd.DataFrame(np.column_stack([coef, at_one]), columns=[f"c{i}" for i in range(d + 1)])
    return fit


def forward_selection(A, b, yy, k, alpha):
    """Indexes of ``k`` features in the order that raises the explained sum of squares of a ridge most.

    ``A`` and ``b`` are centred weighted sums (z z' and z y), ``yy`` that of y; ties go to the first feature.
    """
    chosen = []
    for _ in range(min(k, len(b))):
        gains = []
        for j in range(len(b)):
            if j in chosen:
                gains.append(-np.inf)
                continue
            s = chosen + [j]
            coef = np.linalg.solve(A[np.ix_(s, s)] + alpha * np.eye(len(s)), b[s])
            gains.append(2 * coef @ b[s] - coef @ A[np.ix_(s, s)] @ coef - yy)
        chosen.append(int(np.argmax(np.round(gains, 12))))
    return chosen


def lime_solver(drawn, scores, id_col, cols, classes, alpha, k):
    """mapInPandas body of EX3: one weighted ridge a row from the shared samples and the row itself.

    ``drawn`` (samples x features) holds the drawn intervals, ``scores`` (samples x classes) their scores.
    """
    d = len(cols)
    width2 = 0.5625 * d  # (0.75 sqrt(d))^2

    # a sample tells a row only a mask: the features whose drawn interval is the row's
    masks = np.arange(1 << d)
    z = (masks[:, None] >> np.arange(d) & 1).astype(float)
    w = np.sqrt(np.exp(-(1.0 - z).sum(1) / width2))
    same = [{v: (drawn[:, j] == v).astype(np.int64) << j for v in np.unique(drawn[:, j]).tolist()} for j in range(d)]
    squares = scores ** 2

    def sums(bins):
        """Weighted sums of the samples for one vector of intervals: w, z, z z', y and z y of each class, y^2."""
        mask = np.zeros(len(drawn), np.int64)
        for j, v in enumerate(bins.tolist()):
            if v in same[j]:
                mask |= same[j][v]
        many = w * np.bincount(mask, minlength=1 << d)
        y = w[:, None] * np.column_stack([np.bincount(mask, scores[:, c], 1 << d) for c in range(len(classes))])
        wz = z * many[:, None]
        return many.sum(), wz.sum(0), z.T @ wz, y.sum(0), z.T @ y, w @ np.column_stack(
            [np.bincount(mask, squares[:, c], 1 << d) for c in range(len(classes))])

    def run(frames):
        known = {}
        for f in frames:
            bins = f[[f"d_{c}" for c in cols]].to_numpy()
            own = f[[f"y_{y}" for y in classes]].to_numpy(float)
            best = np.argmax(own, axis=1) if len(f) else np.zeros(0, int)
            take = list(range(d)) if k >= d else None
            n = min(k, d)
            picked, coefs, at_one = np.zeros((len(f), n), int), np.zeros((len(f), n)), np.zeros(len(f))
            distinct, which = np.unique(bins, axis=0, return_inverse=True) if len(f) else (bins, np.zeros(0, int))
            order = np.argsort(which.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(which.ravel(), minlength=len(distinct)))
            if len(known) > KNOWN:
                known.clear()
            for v, lo, hi in zip(distinct, np.concatenate([[0], ends[:-1]]) if len(ends) else [], ends):
                key = v.tobytes()
                if key not in known:
                    known[key] = sums(v)
                sw, sz, szz, sy, szy, syy = known[key]
                i = order[lo:hi]
                c = best[i]
                y0 = own[i, c]
                # the row itself: all ones, weight 1
                sw, sz, szz = sw + 1.0, sz + 1.0, szz + 1.0
                sy, szy, syy = sy[c] + y0, szy[:, c] + y0, syy[c] + y0 * y0
                A = szz - np.outer(sz, sz) / sw
                b = szy - sz[:, None] * sy / sw
                if take:
                    picked[i] = take
                    coefs[i] = np.linalg.solve(A + alpha * np.eye(d), b).T
                else:
                    for m, row in enumerate(i):
                        s = sorted(forward_selection(A, b[:, m], syy[m] - sy[m] * sy[m] / sw, k, alpha))
                        picked[row], coefs[row] = s, np.linalg.solve(A[np.ix_(s, s)] + alpha * np.eye(len(s)), b[s, m])
                at_one[i] = sy / sw + (coefs[i] * (1.0 - sz[picked[i]] / sw)).sum(1)
            names = np.array(cols, dtype=object)
            yield pd.DataFrame({"id": np.repeat(f[id_col].to_numpy(), n), "feature": names[picked.ravel()], "attribution": coefs.ravel(),
                                "bin": np.take_along_axis(bins, picked, 1).ravel() if len(f) else np.zeros(0, int),
                                "class": np.repeat(np.array(classes)[best], n), "local_prediction": np.repeat(at_one, n)})
    return run


def metrics_from_archive(batches):
    """mapInPandas body of IO7: open each archive row, read its *_data.json members."""
    import io
    import json
    import os
    import tarfile
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            key = os.path.basename(path).split("_")[0]
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                for member in tar.getmembers():
                    if not member.isfile() or not member.name.endswith("_data.json"):
                        continue
                    data = json.load(tar.extractfile(member))
                    model = os.path.basename(member.name)[: -len("_data.json")]
                    for metric, value in (data.get("Analysis") or {}).items():
                        if isinstance(value, (int, float)) and not isinstance(value, bool):
                            out.append((key, model, metric, float(value)))
        yield pd.DataFrame(out, columns=["key", "model", "metric", "value"])


def mlp_partition_gradients(batches, weights, n_in, n_hidden):
    """mapInPandas body of the MLP regressor: squared-error gradient sums of one
    partition for the network y = w2 . relu(W1 x + b1) + b2 (features in
    column ``x`` as arrays, target in ``y``).  Yields one row per partition."""
    w = np.asarray(weights, dtype=float)
    i = 0
    W1 = w[i:i + n_in * n_hidden].reshape(n_hidden, n_in); i += n_in * n_hidden
    b1 = w[i:i + n_hidden]; i += n_hidden
    w2 = w[i:i + n_hidden]; i += n_hidden
    b2 = w[i]
    g = np.zeros_like(w)
    loss, n = 0.0, 0
    for pdf in batches:
        if len(pdf) == 0:
            continue
        X = np.vstack(pdf["x"].to_numpy()).astype(float)
        y = pdf["y"].to_numpy(dtype=float)
        H = X @ W1.T + b1
        A = np.maximum(H, 0.0)
        out = A @ w2 + b2
        err = out - y
        loss += float((err ** 2).sum())
        n += len(y)
        dA = np.outer(err, w2) * (H > 0)
        j = 0
        g[j:j + n_in * n_hidden] += (dA.T @ X).ravel(); j += n_in * n_hidden
        g[j:j + n_hidden] += dA.sum(axis=0); j += n_hidden
        g[j:j + n_hidden] += A.T @ err; j += n_hidden
        g[j] += err.sum()
    yield pd.DataFrame({"grad": [g.tolist()], "loss": [loss], "n": [n]})
