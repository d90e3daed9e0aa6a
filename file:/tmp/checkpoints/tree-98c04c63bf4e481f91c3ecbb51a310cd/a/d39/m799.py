x799