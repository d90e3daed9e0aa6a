x196