x421