x955