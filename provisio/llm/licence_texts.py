"""Licence templates by SPDX-like id: full texts of short licences; bodies, notices and phrases of longer ones.  Fixed
values: the wording is the licences' own; placeholders for holders and years are left out."""

from . import licence_bodies as bodies

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_BSD_ADVERT = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
This product includes software developed by the organization."""

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""

_GPL = """This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} License for more details."""

_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which
accompanies this distribution, and is available at {}"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _notice(kind: str, version: str, thing: str = "program") -> str:
    return _GPL.format(thing, kind, version, thing, kind)


_CC = "This work is licensed under the Creative Commons {} 4.0 International License."

TEMPLATES: dict[str, list[str]] = {
    "MIT": [_MIT, "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "BSD-2-Clause": [f"{_BSD_HEAD}\n{_BSD_TAIL}", "Licensed under the 2-Clause BSD License."],
    "BSD-3-Clause": [f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}", "Licensed under the 3-Clause BSD License."],
    "BSD-4-Clause": [f"{_BSD_HEAD}\n{_BSD_ADVERT}\n{_BSD_THIRD.replace('3.', '4.', 1)}\n{_BSD_TAIL}", "Licensed under the 4-Clause BSD License."],
    "ISC": [_ISC, "Released under the ISC License."],
    "Apache-2.0": [bodies.APACHE_2, _APACHE, "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."],
    "GPL-2.0": [bodies.GPL_2, _notice("General Public", "2"), "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [bodies.GPL_3, _notice("General Public", "3"), "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3."],
    "AGPL-3.0": [bodies.AGPL_3, _notice("Affero General Public", "3"), "This work is licensed under the GNU Affero General Public License, version 3."],
    "LGPL-2.1": [bodies.LGPL_2_1, _notice("Lesser General Public", "2.1", "library"), _notice("Lesser General Public", "2.1"),
                 "This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": [bodies.LGPL_3, _notice("Lesser General Public", "3"), _notice("Lesser General Public", "3", "library"),
                 "This work is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": [bodies.MPL_2, _MPL],
    "EPL-1.0": [_EPL.format("v1.0", "http://www.eclipse.org/legal/epl-v10.html")],
    "EPL-2.0": [_EPL.format("v2.0", "https://www.eclipse.org/legal/epl-2.0")],
    "BSL-1.0": [bodies.BSL_1, "Distributed under the Boost Software License, Version 1.0."],
    "Zlib": [_ZLIB],
    "Unlicense": [bodies.UNLICENSE, bodies.UNLICENSE.split("\n\nTHE SOFTWARE")[0], "This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": [_CC.format("Attribution"), "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": [_CC.format("Attribution-ShareAlike"), "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": [_CC.format("Attribution-NonCommercial"), "Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": [_CC.format("Attribution-NoDerivatives"), "Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": [_CC.format("Attribution-NonCommercial-ShareAlike"), "Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-NC-ND-4.0": [_CC.format("Attribution-NonCommercial-NoDerivatives"), "Licensed under CC BY-NC-ND 4.0."],
    "CC0-1.0": [bodies.CC0_1, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
}
