"""License notices to look for.  Fixed values: the wording must be that of the licenses."""

MIT_TERMS = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_TERMS = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""

APACHE_TERMS = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""

MPL_TERMS = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

UNLICENSE_TERMS = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

_GNU_NAMES = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
_CREATIVE = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_CREATIVE_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}


def templates() -> list[tuple[str, str]]:
    """(license, wording), long notices and one-line ones."""
    found = [
        ("MIT", MIT_TERMS), ("ISC", ISC_TERMS), ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
        ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_TAIL), ("Apache-2.0", APACHE_TERMS), ("MPL-2.0", MPL_TERMS),
        ("Unlicense", UNLICENSE_TERMS),
        ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
        ("ISC", "Licensed under the ISC License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
        ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
        ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
        ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
        ("Unlicense", "Released into the public domain under the Unlicense."),
        ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
        ("Proprietary", "All rights reserved."),
    ]
    for short, name in _GNU_NAMES.items():
        for version in _GNU_VERSIONS[short]:
            own = f"{short}-{version if '.' in version else version + '.0'}"
            found.append((own, _GNU.format(name=name, version=version)))
            found.append((own, f"This work is licensed under the {name}, version {version}."))
    for kind in _CREATIVE:
        spelled = "-".join(_CREATIVE_NAMES[k] for k in kind.split("-"))
        for version in ("3.0", "4.0"):
            found.append((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}."))
            found.append((f"CC-{kind}-{version}", f"This work is licensed under a Creative Commons {spelled} {version} International License."))
    return found
