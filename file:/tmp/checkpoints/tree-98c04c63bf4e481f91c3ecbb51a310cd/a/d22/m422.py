x422