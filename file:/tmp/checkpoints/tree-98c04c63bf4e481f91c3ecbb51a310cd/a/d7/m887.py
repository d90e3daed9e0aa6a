x887