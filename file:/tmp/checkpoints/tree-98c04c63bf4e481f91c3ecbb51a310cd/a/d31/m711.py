x711