x593