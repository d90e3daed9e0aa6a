x350