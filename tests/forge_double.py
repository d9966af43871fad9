"""A forge that answers from memory, for tests."""

import json
import re

BOT = {"name": "dependabot[bot]", "email": "noreply@github.com", "date": "2026-03-02T08:00:00Z"}


def person(i):
    return {"name": f"Dev {i}", "email": f"dev{i}@team.example", "date": f"2026-03-{i + 1:02d}T09:30:00Z"}


def hub_commit(sha, who):
    files = [{"filename": f"src/{sha}.py", "status": "added", "patch": "+x", "additions": 3, "deletions": 1}]
    return {"sha": sha, "html_url": f"https://forge.invalid/{sha}", "commit": {"author": who, "committer": who, "message": f"Change {sha}\n\nmore"}, "stats": {"additions": 3, "deletions": 1, "total": 4},
            "parents": [{"sha": "p"}], "files": files}


HUB = {"main": [hub_commit("c1", person(1)), hub_commit("c2", person(2)), hub_commit("c3", BOT)], "fix": [hub_commit("c2", person(2)), hub_commit("c4", person(3))]}
PULLS = [{"id": 10 + n, "number": n, "title": f"Request {n}", "body": None, "state": "closed", "user": {"login": who}, "created_at": "2026-03-05T00:00:00Z", "updated_at": f"2026-03-{5 + n:02d}T00:00:00Z",
          "merged_at": "2026-03-06T00:00:00Z", "closed_at": "2026-03-06T00:00:00Z", "head": {"ref": "fix"}, "base": {"ref": "main"}, "html_url": "u"} for n, who in ((1, "dev1"), (2, "renovate[bot]"))]


def github(url, headers):
    path = re.sub(r"[?&](per_page|page)=\d+", "", url.removeprefix("https://hub.invalid"))
    if path.startswith("/orgs/"):
        body = [{"full_name": "team/a", "archived": False}, {"full_name": "team/old", "archived": True}]
    elif m := re.fullmatch(r"/repos/team/a/commits/(\w+)", path):
        body = next(c for cs in HUB.values() for c in cs if c["sha"] == m[1])
    elif m := re.match(r"/repos/team/a/commits\?sha=(\w+)", path):
        body = [{"sha": c["sha"]} for c in HUB[m[1]]]
    elif path == "/repos/team/a/branches":
        body = [{"name": b} for b in HUB]
    elif path.startswith("/repos/team/a/pulls?"):
        body = PULLS
    elif path == "/repos/team/a/pulls/1/commits":
        body = [{"sha": "c1"}, {"sha": "c4"}]
    else:
        return 404, {}, ""
    return 200, {"link": ""}, json.dumps(body)


def lab_commit(i, name="Dev", email="dev@team.example"):
    day = f"2026-03-{i:02d}T09:30:00.000+00:00"
    return {"id": f"l{i}", "title": f"Change {i}", "message": "m", "author_name": name, "author_email": email, "committer_name": name, "committer_email": email, "authored_date": day, "committed_date": day,
            "created_at": day, "web_url": "u", "parent_ids": ["p", "q"], "stats": {"additions": 1, "deletions": 1, "total": 2}}


def gitlab(url, headers):
    path = re.sub(r"[?&](per_page|page)=\d+", "", url.removeprefix("https://lab.invalid"))
    diff = [{"old_path": "a.py", "new_path": "a.py", "diff": "+a\n-b", "new_file": False, "renamed_file": False, "deleted_file": False}]
    answers = {
        "/projects/team%2Fb": {"id": 7, "path_with_namespace": "team/b"},
        "/projects/7/repository/branches": [{"name": "main", "commit": {"committed_date": "2026-03-09T00:00:00Z"}}, {"name": "old", "commit": {"committed_date": "2020-01-01T00:00:00Z"}}],
        "/projects/7/repository/commits?with_stats=true&ref_name=main&since=2026-01-01": [lab_commit(1), lab_commit(2), lab_commit(3, "GitLab CI", "gitlab@localhost")],
        "/projects/7/repository/commits/l1/diff": diff, "/projects/7/repository/commits/l2/diff": [], "/projects/7/repository/commits/l3/diff": diff,
        "/projects/7/merge_requests?state=all&order_by=updated_at&sort=desc": [{"id": 70 + n, "iid": n, "title": "t", "state": "merged", "author": {"name": "Dev"}, "updated_at": f"{year}-03-05T00:00:00Z"} for n, year in ((1, 2026), (2, 2019))],
        "/projects/7/merge_requests/1/commits": [{"id": "l1"}],
    }
    return (200, {"x-next-page": ""}, json.dumps(answers[path])) if path in answers else (404, {}, "")


def growing(url, headers):
    """A forge in a JSON file, which tests let grow: commits by repository (sha, date, author), request numbers, and paths that fail. Each request is noted beside it."""
    file, _, path = url.removeprefix("https://grow.invalid").partition("//api")
    with open(file, encoding="utf-8") as f:
        state = json.load(f)
    path = re.sub(r"[?&](per_page|page)=\d+", "", path)
    with open(f"{file}.asked", "a", encoding="utf-8") as f:
        f.write(path + "\n")
    if any(x in path for x in state.get("failing", [])):
        return 500, {}, "broken"
    m = re.match(r"/repos/(\w+/\w+)/(\w+)(?:/(\w+))?(?:\?(.*))?", path)
    repo, what, name, asked = m.groups()
    options = dict(x.split("=", 1) for x in (asked or "").split("&") if x)
    listed = sorted(state["commits"].get(repo, []), key=lambda c: c["date"], reverse=True)
    whole = lambda c: hub_commit(c["sha"], {"name": c["who"], "email": f"{c['who']}@x.example", "date": c["date"]})
    if what == "branches":
        body = [{"name": "main"}]
    elif what == "commits" and name:
        body = next((whole(c) for c in listed if c["sha"] == name), None)
    elif what == "commits":
        body = [{"sha": c["sha"], "commit": whole(c)["commit"]} for c in listed if options.get("since", "") <= c["date"] <= options.get("until", "9")]
    elif what == "pulls" and name:
        body = [{"sha": c["sha"]} for c in listed[:1]]
    else:
        body = [{"id": int(f"{n}{len(repo)}"), "number": n, "title": "t", "state": "closed", "user": {"login": "d"}, "created_at": day, "updated_at": day, "merged_at": day, "head": {"ref": "f"}, "base": {"ref": "main"}} for n, day in state.get("pulls", {}).get(repo, [])]
    return (404, {}, "") if body is None else (200, {"link": ""}, json.dumps(body))
