x694