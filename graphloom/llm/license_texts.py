"""The table of licence templates: full texts, standard headers, titles; several for a licence."""

from __future__ import annotations

from pathlib import Path

_HERE = Path(__file__).parent / "licenses"


def _gnu(name: str, version: str, noun: str = "program", only: bool = False) -> str:
    which = f"version {version} of the License." if only else f"either version {version} of the License, or (at your option) any later version."
    return (
        f"This {noun} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {which}\n\n"
        f"This {noun} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\n"
        f"You should have received a copy of the {name} along with this {noun}. If not, see <https://www.gnu.org/licenses/>."
    )


_GNU = (("GPL", "GNU General Public License", ("1", "2", "3")), ("LGPL", "GNU Library General Public License", ("2",)), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
_MIT_0 = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
_HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/\n\nSoftware distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("MIT-0", _MIT_0),
    ("MIT", _MIT_0[:-1] + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
)


#: The dates in the titles of the GNU licences.
_TITLES = (
    ("GPL-1.0", "GNU General Public License", "Version 1, February 1989"),
    ("GPL-2.0", "GNU General Public License", "Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License", "Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License", "Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License", "Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "Version 3, 19 November 2007"),
)


def templates() -> list[tuple[str, str]]:
    """(license, text) of every template."""
    full = [(p.name.removesuffix(".txt"), p.read_text("utf-8", "replace")) for p in sorted(_HERE.glob("*.txt"))]
    gnu = [(f"{short}-{v if '.' in v else v + '.0'}", _gnu(name, v, noun, only)) for short, name, versions in _GNU for v in versions for noun in (("library",) if short == "LGPL" else ("program",)) for only in (False, True)]
    return full + gnu + list(_HEADERS) + [(short, f"{name} {version}") for short, name, version in _TITLES]
