"""A small solution written to disk, with answers derived by hand (FIXTURES.md, section 3)."""

from __future__ import annotations

import os

TYPE = "{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}"

SOLUTION = f"""Microsoft Visual Studio Solution File, Format Version 12.00
Project("{{2150E333-8FDC-42A3-9474-1A3956D46DE8}}") = "src", "src", "{{F1}}"
EndProject
Project("{TYPE}") = "Shop.Core", "src\\Shop.Core\\Shop.Core.csproj", "{{A1}}"
EndProject
Project("{TYPE}") = "Shop.Data", "src/Shop.Data/Shop.Data.csproj", "{{A2}}"
EndProject
Project("{TYPE}") = "Shop.Web", "src/Shop.Web/Shop.Web.csproj", "{{A3}}"
EndProject
Project("{TYPE}") = "Shop.Tests", "test/Shop.Tests/Shop.Tests.csproj", "{{A4}}"
EndProject
Global
	GlobalSection(NestedProjects) = preSolution
		{{A1}} = {{F1}}
		{{A2}} = {{F1}}
		{{A3}} = {{F1}}
	EndGlobalSection
EndGlobal
"""

FILES = {
    "src/Shop.Core/Shop.Core.csproj": """<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup>
<ItemGroup><ProjectReference Include="..\\Shop.Data\\Shop.Data.csproj" /></ItemGroup></Project>""",
    "src/Shop.Data/Shop.Data.csproj": """<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup>
<ItemGroup><ProjectReference Include="../Shop.Core/Shop.Core.csproj" /><ProjectReference Include="../../ext/Lib/Lib.csproj" />
<PackageReference Include="Dapper" Version="2" /></ItemGroup>
<ItemGroup Condition="'$(X)'=='1'"><ProjectReference Include="../Shop.Core/Shop.Core.csproj" /></ItemGroup></Project>""",
    "src/Shop.Web/Shop.Web.csproj": """<Project Sdk="Microsoft.NET.Sdk.Web"><PropertyGroup><TargetFrameworks> net8.0;net9.0</TargetFrameworks></PropertyGroup>
<ItemGroup><ProjectReference Include="../Shop.Core/Shop.Core.csproj" /><ProjectReference Include="../Shop.Data/Shop.Data.csproj" />
<PackageReference Include="Serilog" /><PackageReference Include="serilog" /></ItemGroup></Project>""",
    "test/Shop.Tests/Shop.Tests.csproj": """<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup>
<ItemGroup><ProjectReference Include="../../src/Shop.Web/Shop.Web.csproj" />
<PackageReference Include="xunit" /><PackageReference Include="Microsoft.NET.Test.Sdk" /></ItemGroup></Project>""",
    "src/Shop.Core/Order.cs": "using System; using Shop.Data; namespace Shop.Core;",
    "src/Shop.Core/Globals.cs": "global using Shop.Core.Util;",
    "src/Shop.Core/Util/Text.cs": "namespace Shop.Core { namespace Util { } }",
    "src/Shop.Data/Repo.cs": "using static Shop.Core.Order; using A = Shop.Web; // using Shop.Web;\nnamespace Shop.Data;",
    "src/Shop.Data/obj/Gen.cs": "using Shop.Web; namespace Shop.Generated;",
    "src/Shop.Web/Program.cs": "using Shop.Core;",
    "src/Shop.Web/Home.cs": "using Shop.Core; using Shop.Data;\n#if DEBUG\nusing Shop.Core.Util;\n#endif\nnamespace Shop.Web;",
    "test/Shop.Tests/T.cs": "using Shop.Web; namespace Shop.Tests;",
}


def write_solution(folder) -> str:
    for name, text in {"Shop.sln": SOLUTION, **FILES}.items():
        path = os.path.join(str(folder), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return os.path.join(str(folder), "Shop.sln")
