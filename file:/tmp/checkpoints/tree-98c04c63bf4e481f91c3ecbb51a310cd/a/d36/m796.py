x796