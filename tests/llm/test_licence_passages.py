"""Licence statements that are wrapped over lines, or several in one line."""

import pytest

from passel.llm.licenses import LEAST_SIMILARITY, OTHERS, TEMPLATES, LicenceModel

MIT = """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation"""
BSD = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:"""


@pytest.fixture(scope="module")
def model():
    return LicenceModel(OTHERS)


def confirmed(model, text):
    return {(n, family) for n, family, _, share in model.scan(text) if share >= LEAST_SIMILARITY}


@pytest.mark.parametrize("notice, family", [(MIT, "mit"), (GPL, "gpl"), (BSD, "bsd")])
def test_wrapped_notices(model, notice, family):
    assert confirmed(model, notice) == {(0, family)}
    # Behind other lines and between blank ones.
    assert confirmed(model, f"Some words of a page\n\nint x = 1;\n{notice}\n\nand others") == {(3, family)}


def test_a_notice_does_not_cross_blank_lines(model):
    first, second, third = GPL.split("\n")
    assert confirmed(model, f"{first}\n\n{second}\n{third}") == set()


def test_a_line_of_two_licences(model):
    assert confirmed(model, "Licensed under the MIT License or the Apache License, Version 2.0.") == {(0, "mit"), (0, "apache-2.0")}
    both = "Released under the 3-clause BSD License. Licensed under the Mozilla Public License, version 2.0."
    assert confirmed(model, both) == {(0, "bsd"), (0, "mpl-2.0")}


@pytest.mark.parametrize(
    "text",
    [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Library General Public License, version 3.",
        "Licensed under the Apache License, Version 1.1.",
        "Licensed under the Mozilla Public License, version 1.1.",
        "Licensed under CC BY-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Released under the ISC License.",
        "This project is licensed under the terms of the ISC license.",
    ],
)
def test_other_licences_are_not_confirmed(model, text):
    assert confirmed(model, text) == set()
    assert confirmed(model, text.replace(" License", "\nLicense")) == set()


def test_each_template_names_its_family_only(model):
    """Words that tell families apart do not hide a family's own wordings."""
    for family, templates in TEMPLATES.items():
        for text in templates:
            assert confirmed(model, text) == {(0, family)}, text
    assert confirmed(model, "Licensed under CC BY-SA 3.0.\nLicensed under CC BY 4.0.") == {(0, "cc-by-sa"), (1, "cc-by")}
